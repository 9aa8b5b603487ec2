"""Documents that hold passages of held-out items."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

from ..functions.text import INVISIBLE
from ..storage import checkpointed

#: Letters and digits in a row that make a passage, by the item's language.
PASSAGE = {"en": 60, "ja": 30}
SHINGLE = 5
RADIUS = 1
#: Bits of a fingerprint in each block: one more block than the radius, so two fingerprints within it agree in one.
BLOCKS = (32, 32)
#: Leading bits of a block by which windows are filtered before they leave a task: 2 MB a block, whatever the data.
FILTER_BITS = 24
#: Bits in a piece of the filter, as Spark's bitmap functions cut it.
PIECE = 1 << 15
#: Least weighted similarity of two windows.
SIMILARITY = 0.8
#: Shares that the windows of documents are dealt to, so that a passage that a third of them hold is no single task.
SALTS = 8
#: Windows fingerprinted at once.
TOGETHER = 1 << 14
_DROP = re.compile(f"[{INVISIBLE}]+")
_OTHER = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Lower case, width forms folded, invisible characters gone."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", _DROP.sub("", text)).lower()


def letters(text: str | None) -> str:
    """Only letters and digits, folded."""
    return _OTHER.sub("", folded(text)) if text else ""


@cache
def _kept() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the ``letters`` of all texts in a row, and where each text starts."""
    forms = [folded(t) for t in texts]
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = _kept()[codes]
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[np.cumsum([0, *map(len, forms)])]


def window_of(passage: int) -> tuple[int, int]:
    """Width and step of the windows: two thirds of a passage, so that any passage holds a window at a multiple of the step."""
    width = passage * 2 // 3
    return width, passage - width + 1


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - SHINGLE + 1), dtype=np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + codes[i : len(h) + i]
    for shift, mix in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mix)
    return h ^ (h >> np.uint64(33))


def simhash(hashes: np.ndarray, places: np.ndarray, shingles: int) -> np.ndarray:
    """Fingerprints of the windows of so many shingles at the places: for each bit the majority over a window's shingles, each as often as it occurs.

    The 64 counts of a window are kept bit by bit, in planes of one word each, and shingles are added to all windows at once.
    """
    out = np.empty(len(places), np.uint64)
    for at in range(0, len(places), TOGETHER):
        here = places[at : at + TOGETHER]
        planes = [np.zeros(len(here), np.uint64) for _ in range(shingles.bit_length())]
        for i in range(shingles):
            carry = hashes[here + i]
            for k in range((i + 1).bit_length()):
                planes[k], carry = planes[k] ^ carry, planes[k] & carry
        # counts over half: compared with the half from the highest plane down
        more, same = np.zeros(len(here), np.uint64), np.full(len(here), ~np.uint64(0))
        for k in reversed(range(len(planes))):
            if (shingles // 2) >> k & 1:
                same = same & planes[k]
            else:
                more = more | same & planes[k]
                same = same & ~planes[k]
        out[at : at + len(here)] = more
    return out


def windows(codes: np.ndarray, starts: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of texts that lie in a row: the text's number, the start in it, and the start in the row."""
    n = np.maximum(0, (np.diff(starts) - width) // step + 1)
    owner = np.repeat(np.arange(len(n)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
    return owner, start, starts[owner] + start


def _block_values(prints: np.ndarray) -> list[np.ndarray]:
    shifts = np.cumsum((0, *BLOCKS[:-1]))
    return [(prints >> np.uint64(s)) & np.uint64((1 << b) - 1) for s, b in zip(shifts, BLOCKS, strict=True)]


def _windows(rows: DataFrame, shapes: list[tuple[int, int, list[np.ndarray] | None]]) -> DataFrame:
    """id, passage, start, print of the windows of rows (id, text) for passages of each length, at its step; with a filter only those of which it has a block."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, starts = letter_codes(batch["text"].tolist())
            hashes = shingle_hashes(codes)
            for passage, step, passing in shapes:
                width, _ = window_of(passage)
                owner, start, place = windows(codes, starts, width, step)
                prints = simhash(hashes, place, width - SHINGLE + 1)
                if passing is not None:
                    at = [(v >> np.uint64(b - FILTER_BITS)).astype(np.int64) for v, b in zip(_block_values(prints), BLOCKS, strict=True)]
                    keep = np.logical_or.reduce([seen[a >> 3] >> (a & 7).astype(np.uint8) & 1 > 0 for seen, a in zip(passing, at, strict=True)])
                    owner, start, prints = owner[keep], start[keep], prints[keep]
                yield pd.DataFrame({"id": batch["id"].to_numpy()[owner], "passage": np.full(len(owner), passage, np.int32), "start": start.astype(np.int32), "print": prints.view(np.int64)})

    return rows.select("id", "text").mapInPandas(cut, "id long, passage int, start int, print long")


def _blocks() -> Column:
    shifts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    return F.posexplode(F.array(*(F.shiftrightunsigned("print", s).bitwiseAND((1 << b) - 1) for s, b in zip(shifts, BLOCKS, strict=True)))).alias("block", "value")


def block_filter(wanted: DataFrame, passage: int) -> list[np.ndarray]:
    """Per block the bits of the values that windows of a passage length have, by their leading FILTER_BITS.

    Spark builds the bits where the windows are; the driver joins pieces of 4 KB, at most 512 a block.
    """
    own = wanted.where(F.col("passage") == passage).select(_blocks())
    leading = F.expr("case " + " ".join(f"when block = {i} then shiftright(value, {b - FILTER_BITS})" for i, b in enumerate(BLOCKS)) + " end")
    pieces = own.select("block", leading.alias("bit")).groupBy("block", (F.col("bit") / PIECE).cast("long").alias("piece")).agg(F.bitmap_construct_agg((F.col("bit") % PIECE)).alias("bits"))
    bits = [np.zeros((1 << FILTER_BITS) // 8, np.uint8) for _ in BLOCKS]
    for row in pieces.collect():
        at = row["piece"] * PIECE // 8
        bits[row["block"]][at : at + PIECE // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


@pandas_udf(StringType())
def letters_udf(texts: pd.Series) -> pd.Series:
    return texts.map(letters)


def weighted_similarity(a: str, b: str) -> float:
    """Shingles that two texts share over all they have, each as often as it occurs."""
    if a == b:
        return 1.0
    x, y = (Counter(t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)) for t in (a, b))
    return (x & y).total() / max(1, (x | y).total())


def shared_run(doc: str, item: str, first: int, last: int, shift: int) -> int:
    """Length of the longest stretch common to both texts that begins or ends among the places first to last of ``doc``, ``item`` being shifted against it."""
    lo, hi = first, last
    while lo > 0 and lo + shift > 0 and doc[lo - 1] == item[lo - 1 + shift]:
        lo -= 1
    while hi < len(doc) and hi + shift < len(item) and doc[hi] == item[hi + shift]:
        hi += 1
    longest = run = 0
    for x, y in zip(doc[lo:hi], item[lo + shift : hi + shift], strict=True):
        run = run + 1 if x == y else 0
        longest = max(longest, run)
    return longest


@pandas_udf(IntegerType())
def run_udf(doc: pd.Series, item: pd.Series, passage: pd.Series, diagonals: pd.Series) -> pd.Series:
    """The longest shared stretch over the alignments, given by shift and the first and last window that met along it.

    A window alone on its alignment is first held to the weighted similarity; where several met, the stretch between decides.
    """
    out = []
    for d, i, p, listed in zip(doc, item, passage, diagonals, strict=True):
        width, _ = window_of(p)
        best = 0
        for x in listed:
            shift, first, last = x["shift"], x["first"], x["last"]
            if first < last or weighted_similarity(d[first : first + width], i[first + shift : first + shift + width]) >= SIMILARITY:
                best = max(best, shared_run(d, i, first, last + width, shift))
        out.append(best)
    return pd.Series(out, dtype="int32")


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id where the document holds a passage of the item, with the longest shared stretch (``run``).

    Both texts are compared by their letters and digits. Windows of the size of two thirds of the shortest passage
    that counts are taken from the items at every place and from the documents at steps such that every passage
    holds one whole; each has a SimHash fingerprint. Fingerprints are cut into one block more than the radius, so
    those within it agree in a block and meet in the join; their Hamming distance is then checked, the windows'
    exact weighted similarity of shingles, and last the length of the shared stretch. As a passage brings two equal
    windows, none is missed. Windows none of whose blocks any item has stay in their task, by bits whose size does
    not depend on the data. Windows that met are kept by alignment, the first and the last along each, so what a
    pair of texts comes to is bounded by their lengths.

    Null and empty texts hold nothing; an item without a language is Japanese if it has a letter of its scripts.
    Repeated rows give one row. Extra columns are dropped.
    """
    japanese = F.coalesce("lang", F.when(F.col("text").rlike("[\u3040-ヿ一-鿿]"), "ja").otherwise("en")) == "ja"
    known = items.select(F.col("item_id").alias("id"), "lang", "text").dropna(subset=["id", "text"])
    known = checkpointed(known.select("id", F.when(japanese, PASSAGE["ja"]).otherwise(PASSAGE["en"]).alias("passage"), "text").distinct())
    stored = documents.select(F.col("doc_id").alias("id"), "text").dropna()
    parts, shapes = [], []
    for passage in sorted(PASSAGE.values()):
        parts.append(checkpointed(_windows(known.where(F.col("passage") == passage), [(passage, 1, None)])))
        shapes.append((passage, window_of(passage)[1], block_filter(parts[-1], passage)))
    held = _windows(stored, shapes)
    sought = reduce(DataFrame.unionByName, parts).select(F.col("id").alias("item_id"), "passage", F.col("start").alias("to"), F.col("print").alias("item_print"), _blocks())
    # shuffled by hint: Spark takes the repeated windows for fewer than they are and would send them all to every task
    sought = sought.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).hint("shuffle_hash")
    met = held.select("id", "passage", "start", "print", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), _blocks()).join(sought, ["passage", "block", "value", "salt"])
    near = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    along = near.groupBy("id", "item_id", "passage", (F.col("to") - F.col("start")).alias("shift")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    aligned = checkpointed(along.groupBy("id", "item_id", "passage").agg(F.collect_list(F.struct("shift", "first", "last")).alias("diagonals")))
    plain = stored.join(aligned.select("id").distinct(), "id", "left_semi").select("id", letters_udf("text").alias("plain")).distinct()
    item_plain = known.select(F.col("id").alias("item_id"), "passage", letters_udf("text").alias("item_plain")).distinct()
    checked = aligned.join(plain, "id").join(item_plain, ["item_id", "passage"]).select("id", "item_id", "passage", run_udf("plain", "item_plain", "passage", "diagonals").alias("run"))
    return checked.where("run >= passage").groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("run").alias("run"))
