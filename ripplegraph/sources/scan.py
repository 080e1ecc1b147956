"""Reads the imports of Go sources and the directives of module files: one pass over a text's tokens.

Both stop where what they look for ends, so that a source costs what stands before its first
declaration. Each gives what it found and, for a text that breaks the rules, what is wrong with it.
"""

from __future__ import annotations

import re

_GO = re.compile(r"(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<quoted>\"(?:[^\"\\\n]|\\.)*\")|(?P<raw>`[^`]*`)|(?P<word>[^\W\d]\w*)|(?P<mark>[;().])|(?P<other>.)", re.S)
_MODULE = re.compile(r"(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<quoted>\"(?:[^\"\\\n]|\\.)*\")|(?P<raw>`[^`]*`)|(?P<arrow>=>)|(?P<mark>[()\[\],])|(?P<word>(?:(?!//|/\*)[^\s()\[\],\"`])+)|(?P<other>.)", re.S)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.))", re.S)
_NAMED = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_VERSION = re.compile(r"v(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?")
#: Directives that blocks may hold, and those whose lines say nothing about packages.
BLOCKS = frozenset("module godebug require exclude replace retract tool ignore".split())
OTHERS = frozenset("godebug exclude retract tool ignore".split())


class Wrong(ValueError):
    """A text that breaks the rules of its language."""


def unquoted(token: str) -> str:
    if token[0] == "`":
        return token[1:-1].replace("\r", "")
    of = lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else chr(int(m[4], 8)) if m[4] else _NAMED.get(m[5], m[5])
    return _ESCAPE.sub(of, token[1:-1])


def _go_tokens(text: str):
    """(kind, token) of what counts; a line's end, also inside a comment, counts as a semicolon."""
    for m in _GO.finditer(text, 1 if text.startswith("﻿") else 0):
        kind = m.lastgroup
        if kind == "line" or (kind == "block" and "\n" in m[0]):
            yield "end", ";"
        elif kind == "mark" and m[0] == ";":
            yield "end", ";"
        elif kind == "other" and text.startswith("/*", m.start()):
            raise Wrong("a comment that never ends")
        elif kind == "other" and m[0] in "\"`":
            raise Wrong("a string that never ends")
        elif kind not in ("space", "comment", "block"):
            yield kind, m[0]
    yield "end", ""


def go_imports(text: str) -> list[str]:
    """The paths that a source imports, in order, each once; what follows the imports isn't read."""
    tokens, found = _go_tokens(text), []

    def following(skip: bool = False):
        kind, token = next(tokens, ("end", ""))
        while skip and kind == "end" and token:
            kind, token = next(tokens, ("end", ""))
        return kind, token

    def spec(kind: str, token: str) -> None:
        if kind == "word" or token == ".":
            kind, token = following()
        if kind not in ("quoted", "raw"):
            raise Wrong(f"an import without a path before {token!r}")
        path = unquoted(token)
        if not path:
            raise Wrong("an import of an empty path")
        found.append(path)

    if following(True) != ("word", "package"):
        raise Wrong("no package clause")
    if following()[0] != "word" or following()[0] != "end":
        raise Wrong("a package clause without a name of its own")
    while following(True) == ("word", "import"):
        kind, token = following()
        if token == "(":
            while (at := following(True))[1] != ")":
                spec(*at)
                kind, token = following()
                if token == ")":
                    break
                if kind != "end" or not token:
                    raise Wrong(f"imports that nothing divides before {token!r}")
        else:
            spec(kind, token)
        if (at := following())[0] != "end":
            raise Wrong(f"an import that {at[1]!r} follows")
    return list(dict.fromkeys(found))


def _module_lines(text: str):
    """The directives as lists of tokens, those of a block each with the block's word."""
    block, line = None, []

    def closed():
        nonlocal block
        if block is not None and line == [")"]:
            block = None
        elif line[1:] == ["("] and block is None:
            block = line[0]
            if block not in BLOCKS:
                raise Wrong(f"a block of {block!r}")
        elif line[1:] == ["(", ")"] and block is None:
            pass
        else:
            return [unquoted(x) if x[0] in "\"`" else x for x in (line if block is None else [block, *line])]
        return None

    for m in _MODULE.finditer(text):
        kind = m.lastgroup
        if kind == "line":
            if line and (found := closed()):
                yield found
            line = []
        elif kind == "block":
            raise Wrong("a comment that isn't one of a line")
        elif kind == "other":
            raise Wrong("a string that never ends")
        elif kind not in ("space", "comment"):
            line.append(m[0])
    if line and (found := closed()):
        yield found
    if block is not None:
        raise Wrong(f"a block of {block!r} that never ends")


def _is_path(name: str) -> bool:
    return name in (".", "..") or name.startswith(("./", "../", "/", ".\\", "..\\")) or re.match(r"[A-Za-z]:", name) is not None


def module_file(text: str) -> dict:
    """module, go, toolchain, requires (path, version) and replaces (path, version, to_path, to_version) of a file."""
    out: dict = {"module": None, "go": None, "toolchain": None, "requires": [], "replaces": []}
    for word, *args in _module_lines(text):
        if word in ("module", "go", "toolchain"):
            if len(args) != 1 or out[word] is not None:
                raise Wrong(f"{word} with {len(args)} values" if len(args) != 1 else f"{word} twice")
            out[word] = args[0]
        elif word == "require":
            if len(args) != 2 or not _VERSION.fullmatch(args[1]):
                raise Wrong(f"require {' '.join(args)}")
            out["requires"].append({"path": args[0], "version": args[1]})
        elif word == "replace":
            at = 1 if args[1:2] == ["=>"] else 2
            if args[at : at + 1] != ["=>"] or len(args) not in (at + 2, at + 3) or _is_path(args[at + 1]) != (len(args) == at + 2):
                raise Wrong(f"replace {' '.join(args)}")
            if any(not _VERSION.fullmatch(v) for v in (*args[1:at], *args[at + 2 :])):
                raise Wrong(f"replace {' '.join(args)}")
            out["replaces"].append({"path": args[0], "version": args[1] if at == 2 else None, "to_path": args[at + 1], "to_version": args[at + 2] if len(args) > at + 2 else None})
        elif word not in OTHERS:
            raise Wrong(f"an unknown word {word!r}")
    if out["module"] is None:
        raise Wrong("no module")
    return out
