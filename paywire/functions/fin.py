"""Row helpers for SWIFT MT text: blocks by matching braces, fields by line starts."""

from __future__ import annotations

import re

_FIELD_START = re.compile("\r?\n:")
_TAG = re.compile("[A-Z0-9]+")


class Bad(Exception):
    """A code of what is wrong."""


def _groups(text: str) -> list[str]:
    """Contents of the `{...}` groups at the top of the text; only ASCII white space may stand between them."""
    found, depth, start = [], 0, 0
    for mark in re.finditer(r"[{}]|[^{}]+", text):
        piece = mark[0]
        if piece == "{":
            depth += 1
            if depth == 1:
                start = mark.end()
        elif depth == 0:
            if piece == "}" or piece.strip(" \t\n\f\r"):
                raise Bad("UnexpectedTrailingBytes")
        elif piece == "}":
            depth -= 1
            if depth == 0:
                found.append(text[start : mark.start()])
    if depth:
        raise Bad("UnbalancedBrace")
    return found


def text_block(content: str) -> list[tuple[str, str]]:
    """(tag, value) of block 4; it ends in a line of one dash, values keep their line ends."""
    trimmed = content.lstrip()
    if trimmed == "-":
        return []
    for end in ("\r\n-", "\n-"):
        if trimmed.endswith(end):
            trimmed = trimmed[: -len(end)]
            break
    else:
        raise Bad("MissingTextTerminator")
    out = []
    for chunk in _FIELD_START.split(trimmed.lstrip(":")) if trimmed else ():
        tag = _TAG.match(chunk)
        if not tag:
            raise Bad("MalformedField")
        out.append((tag[0], chunk[tag.end() :].removeprefix(":")))
    return out


def tagged_block(content: str) -> list[tuple[str, str]]:
    """(tag, value) of blocks 3 and 5: `{tag:value}` groups; inner braces stay in the value."""
    out = []
    try:
        groups = _groups(content)
    except Bad:
        raise Bad("MalformedTag") from None
    for group in groups:
        tag, colon, value = group.partition(":")
        if not tag or not colon:
            raise Bad("MalformedTag")
        out.append((tag, value))
    return out


def parse(text: str) -> dict:
    """b1..b5 by their single digit, each at most once."""
    found: dict = {}
    for group in _groups(text):
        name, colon, content = group.partition(":")
        if not colon:
            raise Bad("MissingBlockSeparator")
        if name not in ("1", "2", "3", "4", "5"):
            raise Bad("InvalidBlockId")
        if f"b{name}" in found:
            raise Bad("DuplicateBlock")
        found[f"b{name}"] = content if name in "12" else text_block(content) if name == "4" else tagged_block(content)
    return found
