"""Which elements style sheets take out of a page: the cascade of ``display`` for one fixed screen.

Sheets are read in one pass; ``@media``, ``@supports``, ``@layer`` and nested rules count, other
at-rules hold nothing for a still page. Selectors of all rules are matched in one walk over the tree.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

# The screen that media queries are answered for; an em has 16 pixels.
WIDTH, HEIGHT = 1280, 800
_SCREEN = {
    "width": WIDTH, "height": HEIGHT, "device-width": WIDTH, "device-height": HEIGHT, "aspect-ratio": WIDTH / HEIGHT,
    "device-aspect-ratio": WIDTH / HEIGHT, "resolution": 1, "-webkit-device-pixel-ratio": 1, "color": 8, "monochrome": 0,
    "color-index": 0, "grid": 0,
}
_STATES = {
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine",
    "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference",
    "prefers-reduced-transparency": "no-preference", "prefers-reduced-data": "no-preference", "forced-colors": "none",
    "inverted-colors": "none", "scripting": "enabled", "update": "fast", "display-mode": "browser", "scan": "progressive",
    "overflow-block": "scroll", "overflow-inline": "scroll", "color-gamut": "srgb", "dynamic-range": "standard",
}
_UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "cm": 96 / 2.54, "mm": 96 / 25.4, "in": 96, "pt": 96 / 72, "pc": 16,
          "dppx": 1, "x": 1, "dpi": 1 / 96, "dpcm": 2.54 / 96, "vw": WIDTH / 100, "vh": HEIGHT / 100}
_AMOUNT = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+))([a-z]*)$")
_RATIO = re.compile(r"(\d+)\s*/\s*(\d+)$")
_COMPARE: dict[str, Callable[[float, float], bool]] = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
}

_PIECE = re.compile(
    r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|url\([^)\"']*\)|\\.|<!--|-->|[{};]", re.S | re.I
)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex -webkit-flex -webkit-inline-flex grid inline-grid table inline-table "
    "table-row table-cell table-caption table-column table-column-group table-row-group table-header-group "
    "table-footer-group list-item contents flow-root flow ruby ruby-text math -webkit-box -webkit-inline-box initial "
    "inherit unset revert revert-layer".split()
)
_PAIRED = frozenset("block inline flow flow-root flex grid table ruby list-item math".split())

_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n])+"
_SIMPLE = re.compile(
    rf"(?P<any>\*)|(?P<tag>{_NAME})|\.(?P<cls>{_NAME})|#(?P<id>{_NAME})"
    rf"|\[\s*(?P<key>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>{_NAME}))\s*(?P<case>[is])?\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?P<args>\()?",
    re.I,
)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"(?:([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))$")
# States that a page nobody touches is not in.
_NEVER = frozenset("hover focus active visited target focus-within focus-visible fullscreen modal popover-open autofill".split())
# Nested rules are written out with their parents' selectors up to this length.
_LONGEST = 1 << 16


def _amount(text: str) -> float | None:
    if m := _RATIO.match(text):
        return int(m[1]) / int(m[2]) if int(m[2]) else None
    m = _AMOUNT.match(text)
    return float(m[1]) * _UNITS[m[2]] if m and m[2] in _UNITS else None


def _feature(text: str) -> bool | None:
    """Whether the screen has a feature, None if it is not known."""
    name, colon, value = (part.strip() for part in text.partition(":"))
    if colon:
        for prefix, sign in (("min-", ">="), ("max-", "<="), ("-webkit-min-", ">="), ("-webkit-max-", "<=")):
            if name.startswith(prefix):
                name = ("-webkit-" if prefix[0] == "-" else "") + name[len(prefix) :]
                break
        else:
            sign = "="
        if name in _STATES:
            return _STATES[name] == value if sign == "=" else None
        wanted = _amount(value)
        return _COMPARE[sign](_SCREEN[name], wanted) if name in _SCREEN and wanted is not None else None
    parts = [part.strip() for part in re.split(r"(<=|>=|<|>|=)", text)]
    if len(parts) == 1:
        return _STATES[name] not in ("none", "no-preference") if name in _STATES else bool(_SCREEN[name]) if name in _SCREEN else None
    values = [_SCREEN[p] if p in _SCREEN else _amount(p) for p in parts[::2]]
    if None in values:
        return None
    return all(_COMPARE[sign](a, b) for a, sign, b in zip(values, parts[1::2], values[1:]))


def _inner(text: str) -> list[str]:
    """Words, and whole groups in parentheses."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"[()]|\s+", text):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        if depth == 0 and m[0] != "(":
            out.append(text[start : m.end()].strip())
            start = m.end()
    return [part for part in (*out, text[start:].strip()) if part]


def _condition(words: list[str], leaf: Callable[[str], bool | None], depth: int = 0) -> bool | None:
    """``not``, ``and`` and ``or`` over groups in parentheses and bare words; None is unknown."""
    if words and words[0] == "not":
        value = _condition(words[1:2], leaf, depth) if len(words) == 2 else None
        return None if value is None else not value
    if len(words) % 2 == 0 or depth > 32:
        return None
    values: list[bool | None] = []
    for word in words[::2]:
        if word[0] == "(" and word[-1] == ")":
            inside = word[1:-1].strip()
            group = inside[:1] == "(" or inside[:4] == "not " or inside[:4] == "not("
            parts = _inner(inside.replace("not(", "not (")) if group else []
            values.append(_condition(parts, leaf, depth + 1) if group else leaf(inside))
        else:
            values.append(leaf(word))
    joins = set(words[1::2])
    if joins <= {"and"}:
        return False if False in values else None if None in values else True
    return (True if True in values else None if None in values else False) if joins == {"or"} else None


def _typed(text: str) -> bool | None:
    if text in ("all", "screen"):
        return True
    return False if re.fullmatch(r"[a-z][\w-]*", text) and ":" not in text and text not in _SCREEN | _STATES else _feature(text)


def on_screen(query: str) -> bool:
    """Whether a list of media queries holds for the fixed screen."""
    query = query.strip().lower()
    for one in query.split(",") if query else ["all"]:
        words = _inner(re.sub(r"\b(and|not|or)\(", r"\1 (", one.strip().replace(")and", ") and").replace(")or", ") or")))
        if words[:1] == ["only"]:
            words = words[1:]
        if words[:1] == ["not"] and len(words) > 2 and words[1][0] != "(":
            # Before a type, "not" turns the whole query around.
            if _condition(words[1:], _typed) is False:
                return True
        elif _condition(words, _typed):
            return True
    return False


def _supported(text: str) -> bool | None:
    """Current browsers have what sheets ask for, except for other makers' properties."""
    return not text.strip().startswith(("-moz-", "-ms-", "-o-"))


def _display(value: str) -> str | None:
    """none, shown, or revert for what the browser alone would do; None if browsers drop the value."""
    words = value.lower().split()
    if len(words) == 1 and words[0] in _DISPLAYS:
        return "none" if words[0] == "none" else "revert" if words[0].startswith("revert") else "shown"
    return "shown" if 1 < len(words) < 4 and _PAIRED.issuperset(words) else None


def _declared(declaration: str) -> tuple[bool, str] | None:
    """(important, display) of a declaration of ``display``, None for any other."""
    name, _, value = declaration.partition(":")
    if name.strip().lower() != "display":
        return None
    value, mark, word = value.partition("!")
    if mark and word.strip().lower() != "important":
        return None
    kind = _display(value)
    return (bool(mark), kind) if kind else None


def inline_display(style: str) -> tuple[bool, str] | None:
    """(important, display) of a style attribute."""
    found = [d for part in _COMMENT.sub("", style).split(";") if (d := _declared(part))]
    return max(enumerate(found), key=lambda f: (f[1][0], f[0]))[1] if found else None


def _commas(text: str) -> list[str]:
    out, depth, start, at = [], 0, 0, 0
    for m in re.finditer(r"\"[^\"]*\"?|'[^']*'?|\\.|[()\[\],]", text, re.S):
        if m[0] in ("(", "["):
            depth += 1
        elif m[0] in (")", "]"):
            depth -= 1
        elif m[0] == "," and depth <= 0:
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [*out, text[start:].strip()]


def _plain(name: str) -> str:
    if "\\" not in name:
        return name
    return _ESCAPE.sub(lambda m: m[2] if m[2] else chr(c) if 0 < (c := int(m[1], 16)) < 0xD800 else "\ufffd", name)


class Place:
    """An element among others, as selectors see it."""

    __slots__ = ("node", "classes", "index", "last", "root")

    def __init__(self, node, index: int, last: int, root: bool = False):
        self.node, self.index, self.last, self.root = node, index, last, root
        self.classes = frozenset((node.get("class") or "").split()) if node.attributes else frozenset()


Test = Callable[[Place], bool]


def _nth(text: str) -> Callable[[int], bool] | None:
    text = {"even": "2n", "odd": "2n+1"}.get(text.strip().lower(), text.strip().lower())
    if not (m := _NTH.match(text)):
        return None
    if m[4]:
        return lambda i: i == int(m[4])
    step = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    first = int(m[2] + m[3]) if m[2] else 0
    return lambda i: (i == first) if step == 0 else (i - first) % step == 0 and (i - first) // step >= 0


def _attribute(m: re.Match[str]) -> Test:
    key, op, fold = _plain(m["key"]).lower(), m["op"], (m["case"] or "").lower() == "i"
    wanted = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")
    wanted = _plain(wanted).lower() if fold else _plain(wanted)

    def test(place: Place) -> bool:
        value = place.node.get(key)
        if value is None or not op:
            return value is not None
        value = value.lower() if fold else value
        if op == "=":
            return value == wanted
        if op == "~=":
            return wanted in value.split()
        if op == "|=":
            return value == wanted or value.startswith(wanted + "-")
        if not wanted:
            return False
        return value.startswith(wanted) if op == "^=" else value.endswith(wanted) if op == "$=" else wanted in value

    return test


def _pseudo(name: str, args: str | None, depth: int) -> tuple[Test, tuple[int, int, int]] | None:
    one = (0, 1, 0)
    if name in ("not", "is", "where", "matches", "-webkit-any") and args is not None and depth < 8:
        parts = [_compound(a, 0, depth + 1) for a in _commas(args)]
        if any(p is None or p[1] != len(a) for p, a in zip(parts, _commas(args))):
            return None
        tests = [p[0] for p in parts if p]
        weight = (0, 0, 0) if name == "where" else max(p[2] for p in parts if p)
        wanted = name != "not"
        return (lambda e: any(all(t(e) for t in ts) for ts in tests) == wanted), weight
    if args is not None:
        nth = _nth(args) if name in ("nth-child", "nth-last-child") else None
        if nth is None:
            return None
        return ((lambda e: nth(e.index + 1)) if name == "nth-child" else (lambda e: nth(e.last - e.index + 1))), one
    simple: dict[str, Test] = {
        "root": lambda e: e.root,
        "first-child": lambda e: e.index == 0,
        "last-child": lambda e: e.index == e.last,
        "only-child": lambda e: e.index == e.last == 0,
        "empty": lambda e: not e.node.children,
        "checked": lambda e: e.node.get("selected" if e.node.tag == "option" else "checked") is not None,
        "link": lambda e: e.node.tag in ("a", "area") and e.node.get("href") is not None,
        "disabled": lambda e: e.node.get("disabled") is not None,
        "enabled": lambda e: e.node.tag in ("input", "button", "select", "textarea") and e.node.get("disabled") is None,
        "defined": lambda e: "-" not in e.node.tag,
    }
    simple["any-link"] = simple["link"]
    if name in _NEVER:
        return (lambda e: False), one
    return (simple[name], one) if name in simple else None


def _compound(text: str, at: int, depth: int = 0) -> tuple[list[Test], int, tuple[int, int, int], tuple[str, str]] | None:
    """(tests, end, specificity, key to look it up by) of the simple selectors from ``at``; None if not understood."""
    tests: list[Test] = []
    weight, key, start = [0, 0, 0], ("*", ""), at
    while m := _SIMPLE.match(text, at):
        if (m["tag"] or m["any"]) and at > start:
            return None
        at = m.end()
        if m["tag"]:
            tag = _plain(m["tag"]).lower()
            tests.append(lambda e, tag=tag: e.node.tag == tag)
            weight[2] += 1
            key = ("tag", tag)
        elif m["cls"]:
            name = _plain(m["cls"])
            tests.append(lambda e, name=name: name in e.classes)
            weight[1] += 1
            key = ("class", name) if key[0] != "id" else key
        elif m["id"]:
            name = _plain(m["id"])
            tests.append(lambda e, name=name: e.node.get("id") == name)
            weight[0] += 1
            key = ("id", name)
        elif m["key"]:
            tests.append(_attribute(m))
            weight[1] += 1
        elif m["pseudo"]:
            args = None
            if m["args"]:
                level, start_args = 1, at
                while at < len(text) and level:
                    level += {"(": 1, ")": -1}.get(text[at], 0)
                    at += 1
                if level:
                    return None
                args = text[start_args : at - 1].strip()
            if (found := _pseudo(m["pseudo"].lower(), args, depth)) is None:
                return None
            tests.append(found[0])
            weight = [a + b for a, b in zip(weight, found[1])]
    return (tests, at, tuple(weight), key) if at > start else None


class Styles:
    """The ``display`` rules of all sheets of a page."""

    def __init__(self, sheets: list[str]):
        # (tests, combinator before, number of the part; parts of one selector are consecutive) by key.
        self.index: dict[tuple[str, str], list[tuple[list[Test], str, int]]] = defaultdict(list)
        # By the last part of a selector: what its strongest rule says.
        self.outcome: dict[int, tuple[tuple, bool, str]] = {}
        self.known: dict[str, tuple[int, tuple[int, int, int]] | None] = {}
        self.parts = self.order = 0
        self.layers: dict[tuple[str, ...], int] = {}
        for sheet in sheets:
            if "display" in sheet.lower():
                self.read(sheet)

    def layer(self, path: tuple[str, ...]) -> None:
        for i in range(len(path)):
            self.layers.setdefault(path[: i + 1], len(self.layers))

    def read(self, sheet: str) -> None:
        # What holds in the open blocks: active, selectors, layers.
        blocks: list[tuple[bool, list[str] | None, tuple[str, ...]]] = [(True, None, ())]
        text: list[str] = []
        at = 0
        sheet = sheet.replace("<![CDATA[", "").replace("]]>", "")
        for m in _PIECE.finditer(sheet):
            text.append(sheet[at : m.start()])
            at = m.end()
            if m[0][:2] == "/*":
                text.append(" ")
            elif m[0] == "{":
                blocks.append(self.enter("".join(text).strip(), *blocks[-1]))
                text = []
            elif m[0] in (";", "}"):
                self.statement("".join(text).strip(), *blocks[-1])
                text = []
                if m[0] == "}" and len(blocks) > 1:
                    blocks.pop()
            elif m[0] not in ("<!--", "-->"):
                text.append(m[0])
        self.statement("".join([*text, sheet[at:]]).strip(), *blocks[-1])

    def enter(self, head: str, active: bool, selectors: list[str] | None, layers: tuple[str, ...]):
        if not active:
            return False, None, layers
        if head[:1] != "@":
            names = _commas(head)
            if selectors is not None:
                if sum(map(len, selectors)) * len(names) + len(head) * len(selectors) * max(1, head.count("&")) > _LONGEST:
                    return False, None, layers
                names = [n.replace("&", s) if "&" in n else f"{s} {n}" for s in selectors for n in names]
            return True, names, layers
        name, _, rest = re.sub(r"^(@[\w-]+)", r"\1 ", head).partition(" ")
        name, rest = name.lower(), rest.strip()
        if name == "@media":
            return on_screen(rest), selectors, layers
        if name == "@supports":
            words = _inner(re.sub(r"\b(and|not|or)\(", r"\1 (", rest.lower()))
            return bool(_condition(words, _supported)), selectors, layers
        if name == "@layer":
            layers = (*layers, *(rest.split(".") if rest else [f" {len(self.layers)}"]))
            self.layer(layers)
            return True, selectors, layers
        return False, None, layers

    def statement(self, text: str, active: bool, selectors: list[str] | None, layers: tuple[str, ...]) -> None:
        if not active or not text:
            return
        if selectors is None:
            if text[:7].lower() == "@layer ":
                for name in text[7:].split(","):
                    self.layer((*layers, *name.strip().split(".")))
            return
        if found := _declared(text):
            self.order += 1
            for selector in selectors:
                self.add(selector, *found, layers)

    def add(self, selector: str, important: bool, kind: str, layers: tuple[str, ...]) -> None:
        if selector not in self.known:
            self.known[selector] = self.parse(selector)
        if (known := self.known[selector]) is None:
            return
        last, weight = known
        ranks = [*(self.layers[layers[: i + 1]] for i in range(len(layers))), float("inf")]
        # Without layers wins, the other way round among important ones.
        place = tuple(-r if important else r for r in ranks)
        outcome = ((important, place, weight, self.order), important, kind)
        self.outcome[last] = max(self.outcome.get(last, outcome), outcome)

    def parse(self, selector: str) -> tuple[int, tuple[int, int, int]] | None:
        """Enters the parts; (number of the last one, specificity), None if the selector is not understood."""
        parts, at, before = [], 0, ""
        weight = (0, 0, 0)
        while at < len(selector):
            if (found := _compound(selector, at)) is None:
                return None
            tests, at, more, key = found
            weight = tuple(a + b for a, b in zip(weight, more))
            parts.append((key, tests, before))
            if at < len(selector):
                if not (m := _COMBINATOR.match(selector, at)) or m.end() == len(selector):
                    return None
                at, before = m.end(), m[1] or " "
        for key, tests, before in parts:
            self.index[key].append((tests, before, self.parts))
            self.parts += 1
        return (self.parts - 1, weight) if parts else None

    def decide(self, root, body, head_only: frozenset[str]) -> None:
        """Sets ``display`` of all nodes below ``root``; ``body`` stands for the element that holds all but the head."""
        if not self.outcome:
            return
        top = self.match(Place(root, 0, 0, True), 0, 0, 0, 0)
        inner = self.match(Place(body, 1, 1), top, top, 0, 0)
        nodes = [n for n in root.children if not isinstance(n, str)]
        first = next((i for i, n in enumerate(nodes) if n.tag not in head_only), len(nodes))
        self.siblings(nodes[:first], top, top)
        self.siblings(nodes[first:], inner, inner | top)

    def siblings(self, nodes: list, parent: int, above: int) -> None:
        before = earlier = 0
        for i, node in enumerate(nodes):
            before = self.match(Place(node, i, len(nodes) - 1), parent, above, before, earlier)
            earlier |= before
            if below := [n for n in node.children if not isinstance(n, str)]:
                self.siblings(below, before, above | before)

    def match(self, place: Place, parent: int, above: int, before: int, earlier: int) -> int:
        """The parts that end at this element, as bits; decides its ``display``."""
        node, found = place.node, 0
        keys = [("*", ""), ("tag", node.tag), *(("class", c) for c in place.classes)]
        if node.attributes and (name := node.get("id")) is not None:
            keys.append(("id", name))
        state = {" ": above, ">": parent, "+": before, "~": earlier}
        best = None
        for key in keys:
            for tests, combinator, bit in self.index.get(key, ()):
                if (not combinator or state[combinator] >> (bit - 1) & 1) and all(t(place) for t in tests):
                    found |= 1 << bit
                    if (outcome := self.outcome.get(bit)) and (best is None or outcome > best):
                        best = outcome
        node.display = (best[1], best[2]) if best else None
        return found
