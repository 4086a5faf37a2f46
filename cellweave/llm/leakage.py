"""Evaluation passages inside a corpus: one Aho-Corasick automaton over normalised words, one scan of every text."""

from __future__ import annotations

import bisect
import html
import itertools
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPES = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_TAGS = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|!\w[^<>]*|\|[^<>|]*\|)>", re.S)
_UNITS = re.compile(
    r"\x1b\[[0-9;]*[A-Za-z]|(?:<|&lt;)(?:/?[A-Za-z][^<>&]*|!--.*?--|!\w[^<>&]*|\|[^<>|&]*\|)(?:>|&gt;)|<(?:/?[A-Za-z][^<>]*|!--.*?--|!\w[^<>]*)>|&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);|.", re.S
)
_SILENT = regex.compile(r"(?:[\p{M}\p{Cf}\p{Cs}\p{Co}\p{Variation_Selector}]|(?![\t\n\v\f\r\x1c-\x1f\x85])\p{Cc})+")
_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def _plain(text: str) -> str:
    while "&" in text:  # entities may be escaped again, however often
        once = html.unescape(text)
        if once == text:
            break
        text = once
    if "\x1b" in text:
        text = _ESCAPES.sub("", text)
    return _TAGS.sub(" ", text) if "<" in text else text


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, without entities, tags, case, accents, compatibility forms and invisible characters."""
    t = _plain(text)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", t).casefold())
    else:
        t = t.lower()
    return _WORDS.findall(_SILENT.sub("", t))


class Passages:
    """One Aho-Corasick automaton for all items: of every item the blocks of ``least`` / 2 words that begin at its every such word.

    A run of ``least`` words of an item holds at least one whole block, wherever it begins, so a text without a block shares
    no run. Words are joined without spaces, so one that a line break cut, with a hyphen or without, is itself again.
    """

    def __init__(self, items: list[tuple[int, str]], least: int):
        import ahocorasick

        self.least, self.joined, self.bounds = least, {}, {}
        size = max(1, (least + 1) // 2)
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            w = words_of(text or "")
            if len(w) < least:
                continue
            at = [0]
            for x in w:
                at.append(at[-1] + len(x))
            self.joined[item], self.bounds[item] = "".join(w), at
            for i in range(0, len(w) - size + 1, size):
                places.setdefault("".join(w[i : i + size]), []).append((item, at[i]))
        self.automaton = ahocorasick.Automaton()
        for block, where in places.items():
            self.automaton.add_word(block, (len(block), where))
        if places:
            self.automaton.make_automaton()

    def scan(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (first, last word) in ``text`` of a run that it shares: at least ``least`` words of the item that begin where a word of the text begins and end where one ends."""
        found: dict[int, tuple[int, int]] = {}
        if not len(self.automaton):
            return found
        w = words_of(text)
        if not w:
            return found
        ends = list(itertools.accumulate(map(len, w)))
        begins = {0: 0} | {e: i + 1 for i, e in enumerate(ends)}
        joined = "".join(w)
        for last, (size, where) in self.automaton.iter(joined):
            for item, place in where:
                if item not in found:
                    run = self._run(item, place, last + 1 - size, size, joined, begins)
                    if run:
                        found[item] = run
        return found

    def _run(self, item: int, place: int, at: int, size: int, joined: str, begins: dict[int, int]) -> tuple[int, int] | None:
        """The longest shared run around a block: the block stands at ``place`` of the item and at ``at`` of the text."""
        own, bounds, shift = self.joined[item], self.bounds[item], at - place
        low = place - _common(own[:place][::-1], joined[max(0, at - place) : at][::-1])
        rest = place + size
        high = rest + _common(own[rest:], joined[at + size : at + size + len(own) - rest])
        first = next((i for i in range(bisect.bisect_left(bounds, low), len(bounds)) if bounds[i] + shift in begins), len(bounds))
        last = next((i for i in range(bisect.bisect_right(bounds, high) - 1, -1, -1) if bounds[i] + shift in begins), -1)
        return (begins[bounds[first] + shift], begins[bounds[last] + shift] - 1) if last - first >= self.least else None


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    return len(os.path.commonprefix([a, b]))


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Where each word of ``words_of(text)`` stands in the text itself: (begin, end) in characters.

    Every character is normalised with its origin kept; entities and tags, escaped ones too, are stepped over as a whole.
    """
    units: list[tuple[str, int, int]] = []
    for m in _UNITS.finditer(text):
        s = m.group()
        if s[0] == "\x1b":
            continue
        plain = " " if (s[0] == "<" and len(s) > 1) or (s.startswith("&lt;") and len(s) > 4) else _plain(s) if s[0] == "&" and len(s) > 1 else s
        folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", plain).casefold())
        units += [(c, m.start(), m.end()) for c in _SILENT.sub("", folded)]
    joined = "".join(u[0] for u in units)
    return [(units[m.start()][1], units[m.end() - 1][2]) for m in _WORDS.finditer(joined)]


def leaked_items(
    docs: DataFrame, items: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = 64 << 20
) -> DataFrame:
    """(doc_id, item_id, begin, end): items that share at least ``least`` consecutive words with a text, and where a shared run stands in it.

    The items' texts, whose size is checked against ``most_bytes`` before anything is sent (``ValueError`` beyond), go to all
    tasks; each makes the one automaton of them and scans every text once, whole. Nothing is shuffled. Places are null where
    markup is so nested that words can't be placed. Null and empty texts and items shorter than ``least`` words match
    nothing; null ids are no ids; repeated rows are reported once each; empty tables give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"the evaluation texts have {size} bytes, more than {most_bytes}")
    held = spark.sparkContext.broadcast({"items": [tuple(r) for r in wanted.collect()]})  # at most most_bytes
    source = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held.value  # kept by the worker, and the automaton with it
        if "passages" not in mine:
            mine["passages"] = Passages(mine["items"], least)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True):
                hits = mine["passages"].scan(t)
                if hits:
                    at = word_offsets(t)
                    sure = len(at) == len(words_of(t))
                    rows += [(d, i, at[b][0] if sure else None, at[e][1] if sure else None) for i, (b, e) in hits.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "begin", "end"])

    return source.mapInArrow(look, "doc_id long, item_id long, begin int, end int")
