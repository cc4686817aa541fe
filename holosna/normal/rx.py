"""Searches by pattern text, compiled once."""

from __future__ import annotations

from functools import cache

import regex

compiled = cache(regex.compile)


def search(pattern: str, text: str, **where) -> regex.Match | None:
    return compiled(pattern).search(text, **where)


def match(pattern: str, text: str) -> regex.Match | None:
    return compiled(pattern).match(text)


def fullmatch(pattern: str, text: str) -> regex.Match | None:
    return compiled(pattern).fullmatch(text)


def findall(pattern: str, text: str) -> list:
    return compiled(pattern).findall(text)


def finditer(pattern: str, text: str, **where):
    return compiled(pattern).finditer(text, **where)


def split(pattern: str, text: str, **most) -> list[str]:
    return compiled(pattern).split(text, **most)


def sub(pattern: str, to, text: str) -> str:
    return compiled(pattern).sub(to, text)
