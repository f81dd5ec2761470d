"""Many ordered patterns in one pass over a text: a trie finds all of them, tables tell the first in order."""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that have a meaning of their own in a regular expression.
_SPECIAL = frozenset("\\^$.|?*+()[]{}-&#~")
_LETTER = r"[\p{L}\p{N}]"


def _is_letter(c: str) -> bool:
    return c.isalpha() or c.isnumeric()


def _quoted(c: str) -> str:
    return f"\\{c}" if c in _SPECIAL else c


def trie_regex(words: Sequence[str]) -> str:
    """An expression that matches the longest of ``words`` at a place, its alternatives parted by their first character only.

    A place costs as many steps as a word has characters, times the alphabet at most, however many words there are.
    """
    ordered = sorted({w for w in words if w})

    def below(low: int, high: int, depth: int) -> str:
        """Of the words from low to high, which agree up to depth, what follows there."""
        ends = len(ordered[low]) == depth
        at, branches = low + ends, []
        while at < high:
            start, common = at, ordered[at][depth]
            while at < high and ordered[at][depth] == common:
                at += 1
            # what all words of the branch go on with is one piece
            first, last, size = ordered[start], ordered[at - 1], depth + 1
            while size < min(len(first), len(last)) and first[size] == last[size]:
                size += 1
            branches.append("".join(map(_quoted, first[depth:size])) + (below(start, at, size) if at - start > 1 else ""))
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)})" + "?" * ends

    return below(0, len(ordered), 0)


def _least_of_prefixes(rules: Mapping[str, int], whole_words: bool) -> dict[str, int]:
    """For every word the least rule of those that are found with it: words it begins with, as words where that is asked."""
    out: dict[str, int] = {}
    for word in rules:
        within = (n for n in range(1, len(word) + 1) if not whole_words or n == len(word) or not _is_letter(word[n]))
        out[word] = min(rules[word[:n]] for n in within if word[:n] in rules)
    return out


def least_pattern(texts: Sequence[Column], patterns: Sequence[str], whole_words: bool = False) -> Column:
    """Place (from 0) of the first of ``patterns`` that lies inside any of the texts, null when none does.

    ``whole_words`` asks for no letter or digit on either side. Texts and patterns compare as they are; an
    empty pattern lies in every text, a null text is empty.
    """
    rules: dict[str, int] = {}
    for place, word in enumerate(patterns):
        rules.setdefault(word, place)
    always = rules.pop("", None)
    if not rules:
        return F.lit(always).cast("int")
    size = max(1, len(rules))
    buckets: list[dict[str, int]] = [{} for _ in range(size)]
    for word, place in _least_of_prefixes(rules, whole_words).items():
        buckets[zlib.crc32(word.encode()) % size][word] = place
    table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")
    trie = trie_regex(list(rules))
    # nothing is consumed, so words that overlap are found too
    found = rf"(?<!{_LETTER})(?=({trie})(?!{_LETTER}))" if whole_words else f"(?=({trie}))"

    def places(text: Column) -> Column:
        hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(found), 1)
        return F.transform(hits, lambda h: F.try_element_at(F.element_at(table, (F.crc32(h.cast("binary")) % size + 1).cast("int")), h))

    least = F.array_min(F.concat(*map(places, texts)))
    return least if always is None else F.coalesce(F.least(least, F.lit(always)), F.lit(always))


def value_at(place: Column, values: Sequence[str]) -> Column:
    """The value of a place; null for a null place."""
    return F.get(F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), "array<string>"), place)
