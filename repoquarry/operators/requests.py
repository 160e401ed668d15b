"""Tables of repository requests: URL checks, names, unique names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.urls import is_repository_url, repository_key, repository_name, url_error
from repoquarry.operators.naming import named_in_turn, root_of
from repoquarry.operators.ranking import laid_out_in_ranges, rank_in_ranges, rank_within, sum_below
from repoquarry.sources.shared import materialize


def validated(requests: DataFrame) -> DataFrame:
    """Adds ``is_valid`` and ``error`` for the ``url`` of every request."""
    return requests.withColumns({"is_valid": is_repository_url(F.col("url")), "error": url_error(F.col("url"))})


def named(requests: DataFrame, strict: bool = False) -> DataFrame:
    return requests.withColumn("name", repository_name(F.col("url"), strict))


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(is_repository_url(F.col("url")))


def rejected(requests: DataFrame) -> DataFrame:
    return validated(requests).where(~F.col("is_valid")).drop("is_valid")


def with_first(requests: DataFrame, arrival: str = "req_id", tie: str = "req_id") -> DataFrame:
    """Adds ``repository``, ``kept`` and ``is_kept`` to requests: the first request for a repository is kept.

    All accepted forms of a URL and all spellings in upper and lower case ask for the same repository.
    ``kept`` is the ``tie`` of the first by (``arrival``, ``tie``), for every later one the same, and
    ``is_kept`` says whether it is the request itself. Refused requests ask for none: null, null and
    false. The first is found by partial aggregates, so a repository may be asked for by any share of the
    rows; Spark splits its rows in the join that follows. Rows that are equal in both columns are all kept.
    """
    # Stored, as the key is a long expression and read twice.
    keyed = materialize(requests.withColumn("repository", repository_key(F.col("url"))), "requests")
    first = F.min(F.struct(F.col(arrival).alias("arrival"), F.col(tie).alias("tie"))).alias("_first")
    firsts = keyed.where(F.col("repository").isNotNull()).groupBy(F.col("repository").alias("_key")).agg(first)
    found = keyed.join(firsts, F.col("repository") == F.col("_key"), "left")
    own = F.struct(F.col(arrival).alias("arrival"), F.col(tie).alias("tie"))
    kept = {"kept": F.col("_first.tie"), "is_kept": F.coalesce(own.eqNullSafe(F.col("_first")), F.lit(False))}
    return found.withColumns(kept).drop("_key", "_first")


def deduplicated(requests: DataFrame, arrival: str = "req_id", tie: str = "req_id") -> DataFrame:
    """The first accepted request for every repository, with the columns that ``requests`` has."""
    return with_first(requests, arrival, tie).where("is_kept").select(*requests.columns)


def named_requests(requests: DataFrame, strict: bool = False) -> DataFrame:
    """The whole way of a table of requests (req_id, url): refused or given a name of its own.

    (req_id, url, name, unique_name, error); refused requests have no name and take none from others.
    """
    taken = unique_names(named(accepted(requests), strict)).withColumn("error", F.lit(None).cast("string"))
    refused = rejected(requests)
    return taken.unionByName(refused, allowMissingColumns=True)


# Requests of a root that one task settles in turn; larger roots are cut in ranges.
IN_TURN = 100_000


def unique_names(requests: DataFrame, name: str = "name", arrival: str = "req_id", tie: str = "req_id") -> DataFrame:
    """Adds ``unique_name``: the first of ``x``, ``x_1``, ``x_2``, ... no earlier request has taken.

    Requests meet only where their names agree up to numbers at the end, their root. Roots of up to
    ``IN_TURN`` requests are settled in one ordered pass each; those of larger ones are ranked in ranges.
    Rows without a name get none. Other columns stay; a column ``unique_name`` is replaced.
    """
    # Stored, as names are often long expressions and sizes are counted first.
    requests = materialize(requests, "requests")
    asked = requests.where(F.col(name).isNotNull())
    sizes = asked.groupBy(root_of(F.col(name)).alias("_root")).agg(F.count("*").alias("_n"))
    # One row for every IN_TURN requests at most.
    large = materialize(sizes.where(F.col("_n") > IN_TURN).select("_root"), "large-roots")
    unnamed = requests.where(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string"))
    if not large.limit(1).count():
        return named_in_turn(asked, name, arrival, tie).unionByName(unnamed)
    rooted = asked.withColumn("_root", root_of(F.col(name)))
    small = rooted.join(large, "_root", "left_anti").drop("_root")
    hot = rooted.join(large, "_root", "left_semi").drop("_root")
    found = named_in_turn(small, name, arrival, tie).unionByName(named_in_ranges(hot, name, arrival, tie))
    return found.unionByName(unnamed)


def named_in_ranges(requests: DataFrame, name: str = "name", arrival: str = "req_id", tie: str = "req_id") -> DataFrame:
    """``unique_names`` for names that own any share of the rows: no task holds all requests for a name.

    Almost always the suffix is the rank of the request among those for the same name. It is larger
    where other requests name ``x_3`` itself: whichever request comes first holds such a contested
    name, and the loser moves one on, as do all later requests for the loser's name. Those shifts
    decide which request competes for the next contested name. A contest depends only on those of
    lower suffixes and on the one for its parent's own name, so the contests of a parent are decided in
    one ordered pass, and parents are settled by the number of suffixes in their names: as many rounds
    as the longest chain ``x_1_2_3`` of contested names has, however many names are contested.
    """
    ranged = laid_out_in_ranges(requests.withColumn("_name", F.col(name)), "_name", arrival, tie)
    ranked = rank_in_ranges(ranged, "_name", arrival, tie)
    times = ranged.select("_name", F.col(arrival).alias("at"), F.col(tie).alias("tie"))
    contests = _contests(times)
    if contests.isEmpty():
        return _with_suffix(ranked, F.col("rank"))
    contests = materialize(_with_earlier_requests(materialize(contests, "name-contests"), times), "name-contests")
    settled = _settled(contests)
    passed = settled.where("child_wins").groupBy("parent", "claim").agg(F.count("*").alias("_passed"))
    lost = settled.where(~F.col("child_wins")).select(F.col("child").alias("_name"), F.lit(1).alias("_lost"))
    claims = passed.withColumnsRenamed({"parent": "_name", "claim": "rank"})
    shifted = ranked.join(claims, ["_name", "rank"], "left").withColumn("_passed", F.coalesce("_passed", F.lit(0)))
    shifted = sum_below(shifted, "_name", "rank", F.col("_passed"), "_below").join(lost, "_name", "left")
    suffix = F.col("rank") + F.col("_below") + F.col("_passed") + F.coalesce("_lost", F.lit(0))
    return _with_suffix(shifted, suffix)


def _with_suffix(ranked: DataFrame, suffix: Column) -> DataFrame:
    chosen = F.when(suffix == 0, F.col("_name")).otherwise(F.concat_ws("_", "_name", suffix))
    return ranked.withColumn("unique_name", chosen).drop("_name", "rank", "_passed", "_below", "_lost")


def _contests(times: DataFrame) -> DataFrame:
    """Requested names ``child`` that are the ``j``-th variant of another requested name ``parent``.

    ``at`` and ``tie`` are those of the first request for the child.
    """
    names = times.groupBy("_name").agg(F.min(F.struct("at", "tie")).alias("first"))
    variant = r"(?s)^(.*)_([1-9][0-9]*)\z"
    children = names.where(F.col("_name").rlike(variant)).select(
        F.regexp_extract("_name", variant, 1).alias("parent"),
        F.regexp_extract("_name", variant, 2).try_cast("bigint").alias("j"),
        F.col("_name").alias("child"),
        "first.*",
    )
    # No number of requests reaches a suffix beyond a bigint.
    return children.where(F.col("j").isNotNull()).join(names.select(F.col("_name").alias("parent")), "parent", "left_semi")


def _with_earlier_requests(contests: DataFrame, times: DataFrame) -> DataFrame:
    """Adds ``earlier``, the number of requests for the parent before the child's first.

    It is the child's rank among those requests and all rival children, less its rank among the rivals.
    """
    rivals = contests.select("parent", "at", "tie", "child")
    parents = times.join(contests.select(F.col("parent").alias("_name")).distinct(), "_name", "left_semi")
    asked = parents.select(F.col("_name").alias("parent"), "at", "tie", F.lit(None).cast("string").alias("child"))
    among_all = rank_within(asked.unionByName(rivals), "parent", "at", "tie", "all").where(F.col("child").isNotNull())
    among_rivals = rank_within(rivals, "parent", "at", "tie", "others")
    earlier = among_all.join(among_rivals.select("child", "others"), "child").select(
        "child", (F.col("all") - F.col("others")).alias("earlier")
    )
    return contests.select("parent", "j", "child").join(earlier, "child").select("parent", "j", "child", "earlier")


def _settled(contests: DataFrame) -> DataFrame:
    """Adds ``claim``, the rank of the parent's request that reaches the name, and ``child_wins``.

    The child wins if that request comes after its own first one, or if there is no such request.
    Names with the fewest suffixes come first, as a parent that lost its own name starts one later.
    """
    suffixes = F.regexp_extract("child", r"(?:_[1-9][0-9]*)+\z", 0)
    leveled = contests.withColumn("level", F.size(F.split(suffixes, "_")) - 1)
    done: DataFrame | None = None
    # As many numbers as there are suffixes in the longest name.
    for (at,) in sorted(leveled.select("level").distinct().collect()):
        here = leveled.where(F.col("level") == at)
        if done is None:
            here = here.withColumn("lost", F.lit(0))
        else:
            lost = done.where(~F.col("child_wins")).select(F.col("child").alias("parent"), F.lit(1).alias("lost"))
            here = here.join(lost, "parent", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
        ordered = here.select("parent", "j", "child", "earlier", "lost")
        ordered = ordered.repartition("parent").sortWithinPartitions("parent", "j")
        found = materialize(ordered.mapInArrow(_in_turn, _SETTLED), "name-contests")
        done = found if done is None else done.unionByName(found)
    return done


_SETTLED = "parent string, j bigint, child string, earlier bigint, claim bigint, child_wins boolean"


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides sorted contests one after another; of each parent only the number of winners is held."""
    at, passed = None, 0
    for batch in batches:
        claims, wins = [], []
        columns = [batch.column(c).to_pylist() for c in ("parent", "j", "earlier", "lost")]
        for parent, j, earlier, lost in zip(*columns, strict=True):
            if parent != at:
                at, passed = parent, 0
            claims.append(j - passed - lost)
            wins.append(claims[-1] >= earlier)
            passed += wins[-1]
        kept = [batch.column(c) for c in ("parent", "j", "child", "earlier")]
        names = ["parent", "j", "child", "earlier", "claim", "child_wins"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(claims, pa.int64()), pa.array(wins, pa.bool_())], names)
