"""Benchmark passages in documents, up to a share of wrong letters.

An item with an error budget of e is cut into e + 1 pieces: with at most e
errors one piece stays whole, so a dictionary automaton over all pieces finds
every place worth a look. Each place is then verified with the bit-parallel
edit distance of Myers over whole items. Items too short for an error must
occur as they are, and those of few words between word borders.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, materialize, text_column

#: One error for so many characters of the normalised item.
CHARS_PER_ERROR = 16
#: Items of fewer characters are not searched unless the caller asks for it: a single letter is in nearly every text.
MIN_CHARS = 2
#: Texts of these characters alone are their own compatibility form but for what becomes a blank: ASCII, letters of Western and Central Europe, common punctuation.
PLAIN = "\\x00-\\x7f\u00a0-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u012f\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201e\u2022\u20ac"
#: Characters without width that stand within words: soft hyphen, joiners, byte order mark.
_NO_WIDTH = re.compile("[\u00ad\u200c\u200d\u2060\ufeff]")
#: A letter or digit, and what follows of letters, digits and marks; a mark without a letter counts for nothing.
_WORD = re.compile("[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*")
#: An item without room for an error must stand between word borders, unless it has so many words.
BORDER_WORDS = 5
#: Letters of scripts that are written without blanks: Thai to Myanmar, Khmer, kana, Han. Next to them a word may start or end anywhere.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Items are searched in blocks of about so many characters; a block is what is broadcast.
BLOCK_CHARS = 4_000_000
MATCHES = "array<struct<item_id:bigint,distance:int,match_start:int,match_end:int>>"


def normal_form(text: str) -> str:
    """Compatibility form in lower case, with one blank between words of letters, digits and marks.

    Composed, decomposed and compatibility forms of a text are equal in it. Marks
    that don't compose, such as vowel signs, are kept with their letters.
    """
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    lower = text.lower()
    if not lower.isascii() and not unicodedata.is_normalized("NFKC", lower):
        lower = unicodedata.normalize("NFKC", lower)
    return " ".join(_WORD.findall(_NO_WIDTH.sub("", lower)))


def prepared(text: Column) -> Column:
    """A struct of the text and whether it is in normal form: plain texts are brought there by the engine, others where they are searched."""
    text = F.coalesce(text, F.lit(""))
    plain = ~text.rlike(f"[^{PLAIN}]")
    done = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.struct(F.when(plain, done).otherwise(text).alias("text"), plain.alias("done"))


def best_match(pattern: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of a pattern within a text, the first of equals; None beyond ``most``.

    One machine word of any width holds a column of the distance matrix: bit i
    of up and down says whether the distance grows or falls from row i to i + 1.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, most + 1, -1
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        flat = (((x & up) + up) ^ up) | x
        right_up, right_down = down | (full & ~(flat | up)), up & flat
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
        up, down = right_down | (full & ~(x | right_up)), right_up & x
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return (best, end) if end >= 0 else None


def _border(text: str, at: int) -> bool:
    """Whether a word may start or end before the character ``at`` of a normalised text."""
    return not 0 < at < len(text) or " " in text[at - 1 : at + 1] or _UNSPACED.search(text, at - 1, at + 1) is not None


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


@dataclass
class Block:
    """Items (item_id, normalised text) ready for search; the automaton is built where it is used."""

    items: list[tuple[int, str]]
    ready: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"items": self.items, "ready": None}

    def prepare(self) -> tuple:
        if self.ready is None:
            pieces: dict[str, list[tuple[int, int]]] = {}
            for k, (_, text) in enumerate(self.items):
                parts = len(text) // CHARS_PER_ERROR + 1
                for j in range(parts):
                    low, high = j * len(text) // parts, (j + 1) * len(text) // parts
                    pieces.setdefault(text[low:high], []).append((k, low))
            machine = ahocorasick.Automaton()
            for piece, places in pieces.items():
                machine.add_word(piece, (len(piece), places))
            machine.make_automaton()
            self.ready = machine, [_masks(t) for _, t in self.items], [_masks(t[::-1]) for _, t in self.items]
        return self.ready

    def search(self, text: str) -> list[dict]:
        """Best match of each item that occurs in a normalised text."""
        machine, masks, reverse = self.prepare()
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        if not self.items or not text:
            return []
        for last, (size, places) in machine.iter(text):
            for k, low in places:
                item = self.items[k][1]
                most = len(item) // CHARS_PER_ERROR
                start = last + 1 - size - low
                if not most:  # the item is its only piece
                    if k not in best and (item.count(" ") + 1 >= BORDER_WORDS or _border(text, start) and _border(text, last + 1)):
                        best[k] = (0, start, last + 1)
                    continue
                # starts are tried in runs of most + 1: hits come in any order of start where an item repeats its own pieces
                run = start // (most + 1)
                if (k, run) in tried or k in best and best[k][0] == 0:
                    continue
                tried.add((k, run))
                first = run * (most + 1)
                floor, roof = max(0, first - most), first + len(item) + 2 * most
                found = best_match(item, masks[k], text[floor:roof], most)
                if found and (k not in best or found[0] < best[k][0]):
                    end = floor + found[1]
                    back = best_match(item[::-1], reverse[k], text[max(0, end - len(item) - most) : end][::-1], most)
                    best[k] = (found[0], end - (back[1] if back else len(item)), end)
        return [{"item_id": self.items[k][0], "distance": d, "match_start": a, "match_end": b} for k, (d, a, b) in sorted(best.items())]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> Iterator[Block]:
    """Items of benchmark (item_id, text) in blocks of a bounded size, one at a time; one without items at least.

    Null ids and texts, and items with fewer than ``min_chars`` characters in normal form, are left out.
    """

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([normal_form(t.as_py()) for t in texts], pa.string())

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), normal("text").alias("t"))
    items = materialize(items.where(F.length("t") >= max(1, min_chars)).distinct())
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = int(total // block_chars) + 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(parts)) == k).orderBy("item_id", "t").collect()  # about block_chars characters
        yield Block([(r.item_id, r.t) for r in rows])


def _searcher(block):
    """Arrow function of a broadcast block over ``prepared`` texts."""

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("match_start", pa.int32()), ("match_end", pa.int32())]))
        rows = zip(texts.field("text"), texts.field("done"))
        return pa.array([block.value.search(t.as_py() if done.as_py() else normal_form(t.as_py())) for t, done in rows], kind)

    return run


def _each_block(docs: DataFrame, benchmark: DataFrame, block_chars: int, min_chars: int, apply: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """apply(docs, matches of a block) for one block after another; a block is released before the next one is collected."""
    held = None
    for block in blocks(benchmark, block_chars, min_chars):
        if held is not None:
            docs = materialize(docs)
            held.unpersist()
        held = lean(docs).sparkSession.sparkContext.broadcast(block)
        docs = apply(docs, _searcher(held)(prepared(F.col("text"))))
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, column: str = "matches", block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with an array of the benchmark items found in each text, by item; offsets count characters of the normalised text.

    The new column replaces one of its name; the others stay as they are.
    """
    def add(frame: DataFrame, found: Column) -> DataFrame:
        return frame.withColumn(column, F.array_sort(F.concat(column, found)))

    return _each_block(docs.withColumn(column, F.expr(f"cast(array() as {MATCHES})")), benchmark, block_chars, min_chars, add)


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end): one row for each document and item found in it.

    Documents are whole texts, however long; null and empty texts match nothing.
    Repeated rows each have their matches, null ids too. Of several places of an
    item with the same distance one is given. Other columns are not read. An
    empty table on either side gives no rows.
    """
    found = matches(text_column(docs, "doc_id"), benchmark, "matches", block_chars, min_chars)
    return found.select("doc_id", F.inline("matches"))


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs without any benchmark item, with their columns as they are; rows with a null or empty text stay."""
    found = fresh(docs, "found")

    def drop(frame: DataFrame, hits: Column) -> DataFrame:
        return frame.withColumn(found, F.size(hits)).where(F.col(found) == 0).drop(found)

    return _each_block(docs, benchmark, block_chars, min_chars, drop)
