"""What style sheets say about ``display`` and ``visibility``: nested rules, conditions, order and weight."""

from __future__ import annotations

import re

#: The screen that conditions are decided for, in CSS pixels; an em is FONT of them.
WIDTH, HEIGHT, FONT = 1280, 800, 16
PROPERTIES = ("display", "visibility")

_PIECE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[{};]", re.S)
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_LENGTH = re.compile(r"([+-]?[0-9]*\.?[0-9]+)(px|em|rem)?")
_RANGE = re.compile(r"(?:(.+?)\s*(<=?|>=?|=)\s*)?(width|height)(?:\s*(<=?|>=?|=)\s*(.+))?")
#: Features of the screen that have one value, and what a condition without a value asks for.
_SCREEN = {"orientation": "landscape", "prefers-color-scheme": "light", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "none", "prefers-reduced-motion": "no-preference"}
_HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
#: Rules that hold other rules; of layers and scopes the order alone counts here.
_HOLDERS = ("@media", "@supports", "@layer", "@scope")


def _length(text: str) -> float | None:
    m = _LENGTH.fullmatch(text.strip())
    if not m or (m[2] is None and float(m[1])):
        return None
    return float(m[1]) * (1 if m[2] in ("px", None) else FONT)


def _feature(text: str) -> bool:
    """One condition in brackets, without them; what isn't known doesn't hold."""
    name, colon, value = (x.strip() for x in text.partition(":"))
    if colon:
        if m := re.fullmatch(r"(min|max)-(?:device-)?(width|height)", name):
            size, limit = (WIDTH if m[2] == "width" else HEIGHT), _length(value)
            return limit is not None and (size >= limit if m[1] == "min" else size <= limit)
        if name in ("width", "height"):
            return _length(value) == (WIDTH if name == "width" else HEIGHT)
        return _SCREEN.get(name) == value
    if m := _RANGE.fullmatch(name):
        size = WIDTH if m[3] == "width" else HEIGHT
        left, right = (None if x is None else _length(x) for x in (m[1], m[5]))
        if (m[1] and left is None) or (m[5] and right is None):
            return False
        return (left is None or _HOLDS[m[2]](left, size)) and (right is None or _HOLDS[m[4]](size, right))
    return name in ("color", *_SCREEN) and _SCREEN.get(name) != "none"


def _split(text: str, word: str) -> list[str]:
    """Parts of a text between a word that stands outside all brackets."""
    out, depth, at = [], 0, 0
    for m in re.finditer(rf"[()]|{word}", text):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif not depth:
            out.append(text[at : m.start()])
            at = m.end()
    return [*out, text[at:]]


def _condition(text: str, deep: int = 0) -> bool:
    text = text.strip()
    if deep > 20 or not text:
        return False
    for word, of in ((r"\s+or\s+", any), (r"\s+and\s+", all)):
        if len(parts := _split(text, word)) > 1:
            return of(_condition(x, deep + 1) for x in parts)
    if text.startswith("not") and text[3:4] in " (\t":
        return not _condition(text[3:], deep + 1)
    if text.startswith("(") and text.endswith(")"):
        inner = text[1:-1].strip()
        return _condition(inner, deep + 1) if inner.startswith(("(", "not ", "not(")) else _feature(inner)
    return text in ("all", "screen", "only screen", "only all")


def media_holds(queries: str) -> bool:
    """Whether one of some media queries holds for the screen; an empty list does."""
    queries = queries.lower().strip()
    of = lambda q: not _condition(q[4:]) if re.match(r"not\s+[a-z]", q) else _condition(q)
    return not queries or any(of(q.strip()) for q in _split(queries, ","))


def _applies(prelude: str) -> bool:
    """Whether the rules that an at-rule holds count."""
    name = re.match(r"@[\w-]*", prelude)[0].lower()
    rest = prelude[len(name) :].strip()
    if name == "@media":
        return media_holds(rest)
    if name == "@supports":
        return not re.match(r"not\b", rest, re.I)
    return name in _HOLDERS


def rules(sheet: str):
    """Selectors and declarations of the rules that count, in their order.

    One scan over braces, semicolons, strings and comments, so that its time is in proportion to
    the sheet. A rule inside a rule is left out; what is open at the end is closed there.
    """
    head, stack, clean = 0, [], []  # stack: (prelude of a rule that counts, or None; whether what it holds counts)

    def text(to: int) -> str:
        out = "".join(clean) + sheet[head:to]
        clean.clear()
        return (out if stack else re.sub("<!--|-->", " ", out)).strip()

    body: list[str] = []
    for m in [*_PIECE.finditer(sheet), None]:
        at = m.start() if m else len(sheet)
        kind = m[0][0] if m else "}"
        if kind in "\"'":
            continue
        if kind == "/":
            clean.append(sheet[head:at] + " ")
            head = m.end()
            continue
        said, head = text(at), m.end() if m else at
        counts = not stack or stack[-1][1]
        if kind == "{":
            if not stack or stack[-1][0] is None:
                body = []
                stack.append((None, counts and _applies(said)) if said.startswith("@") else (said, counts))
            else:
                stack.append((None, False))  # inside a rule's own declarations
        elif kind == ";":
            if stack and stack[-1][0] is not None:
                body.append(said)
        elif not stack:
            clean.append("} ")  # a brace that nothing opened spoils the rule that follows
        else:
            while stack:
                prelude, _ = stack.pop()
                if prelude is not None and counts:
                    yield prelude, [*body, said]
                said, counts = "", not stack or stack[-1][1]
                if m:
                    break
            body = body if stack and stack[-1][0] is not None else []


def declared(parts: list[str]) -> dict[str, tuple[bool, str]]:
    """Of each property that counts: whether it is important, and its value; the last such one wins."""
    found: dict[str, tuple[bool, str]] = {}
    for part in parts:
        name, _, value = part.partition(":")
        name = name.strip().lower()
        if name in PROPERTIES:
            value, mark, _ = value.partition("!")
            value = (bool(mark), value.strip().lower())
            if value[1] and value >= (found.get(name, (False, ""))[0], ""):
                found[name] = value
    return found


class Styles:
    """The rules of a page whose selectors name a tag, classes and ids of one element."""

    def __init__(self, sheets: list[str]):
        self.by: dict[str, list] = {}
        order = 0
        for selectors, parts in (r for s in sheets for r in rules(s)):
            found = declared(parts)
            for selector in selectors.split(",") if found else ():
                m = _COMPOUND.fullmatch(selector.strip())
                if m and selector.strip():
                    names = re.findall(r"[.#][\w-]+", m[2])
                    ids = sum(x[0] == "#" for x in names)
                    tag = (m[1] or "*").lower()
                    order += 1
                    weight = (ids, len(names) - ids, int(tag != "*"), order)
                    key = max(names, key=lambda x: x[0] == "#") if names else tag
                    self.by.setdefault(key, []).append((tag, frozenset(names), weight, found))

    def of(self, node, name: str) -> str | None:
        """The value that a node's own style or the sheets give a property, the heaviest and last one."""
        a, best = node.attributes, None
        if self.by:
            mine = {"." + c for c in a.get("class", "").split()}
            if "id" in a:
                mine.add("#" + a["id"])
            for key in ("*", node.tag, *mine):
                for tag, names, weight, found in self.by.get(key, ()):
                    if name in found and tag in ("*", node.tag) and names <= mine:
                        rank = (found[name][0], 0, weight)
                        best = max(best, (rank, found[name][1])) if best else (rank, found[name][1])
        if (style := a.get("style")) and name in style.lower():
            own = declared([p for p in re.sub(r"/\*.*?(?:\*/|\Z)", " ", style, flags=re.S).split(";")]).get(name)
            if own and (best is None or (own[0], 1) > best[0][:2]):
                return own[1]
        return best[1] if best else None
