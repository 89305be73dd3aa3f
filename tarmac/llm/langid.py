"""Language ID by compression: the language whose text, as a dictionary, makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterable

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import annotate, fold, query, shielded, table

UND = "und"
LEVEL = 3
_NOISE = re.compile(r"[^\w ]+|[\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> bytes:
    """Lower case, and one space for what is neither letter nor space."""
    return _NOISE.sub(" ", text.lower()).encode()


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 131072,
        slice_chars: int = 1024, total_bytes: int = 16 << 20) -> dict[str, bytes]:
    """A raw-content dictionary for each language of `train` (rows with a null language or text are passed over).

    A dictionary is a bounded sample: slices of `slice_chars` from texts drawn by their hash, until
    `dict_bytes` (less if there are so many languages that they would pass `total_bytes` together).
    """
    rows = train.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")
    )
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    size = min(dict_bytes, total_bytes // len(counts))
    want = 6 * max(1, size // slice_chars)
    cut = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, want / max(1, n)))))
    drawn = rows.where(F.pmod("h", F.lit(1 << 40)) < cut[F.col("lang")] * (1 << 40))
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - slice_chars, F.lit(1))) + 1
    drawn = drawn.select("lang", "h", F.substr("text", at.cast("int"), F.lit(slice_chars)).alias("part")).distinct()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.lang, r.h, r.part)):
        parts.setdefault(r.lang, []).append(plain(r.part))
    return {k: b" ".join(v)[:size] for k, v in sorted(parts.items()) if _LETTER.search(b" ".join(v)[:size].decode(errors="ignore"))}


class Sizer:
    """Bytes that each language's dictionary leaves of a text."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs, self.tools = list(dictionaries), []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes, block: int) -> list[int]:
        """Blocks are compressed one by one: what counts is the dictionary, not the text's own past."""
        parts = [text[i : i + block] for i in range(0, len(text), block)]
        return [sum(len(t.compress(p)) - 2 for p in parts) for t in self.tools]

    def judge(self, text: bytes, min_margin: float, close: float = 0.02) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected) of a text. Close calls are measured again in small blocks."""
        text = text.decode()
        if not self.langs or not _LETTER.search(text):
            return UND, 0.0, 0.0, True
        data = plain(text)
        sizes = self.sizes(data, 2048)
        if _margin(sizes) < close:
            for block in (512, 128):
                sizes = [a + b for a, b in zip(sizes, self.sizes(data, block), strict=True)]
        best = min(sizes)
        margin = _margin(sizes)
        score = 1 / sum(2.0 ** max(-60, best - s) for s in sizes)
        return self.langs[sizes.index(best)], score, margin, margin < min_margin


#: Chosen on held-out whole texts: the margins of right answers are above 0.02, but for a few exact ties; half of the wrong ones are below this.
MIN_MARGIN = 0.01


def _margin(sizes: list[int]) -> float:
    """What the second smallest has over the smallest, relative to it; 1 if there is one language only."""
    best, *rest = sorted(sizes)
    return (rest[0] - best) / max(1, best) if rest else 1.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN,
             keep_text: bool = False) -> DataFrame:
    """`docs` with _lang, _score (0 to 1), _margin and _rejected.

    A null text or one without a letter is `und`, score 0 and rejected; so is every text if no language was
    learned. Else the smallest size wins (ties: the first language by name) and a text whose margin is under
    `min_margin` is rejected. Whole texts count. Repeated rows get equal answers; other columns stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by fit's total_bytes
    tool: list[Sizer] = []

    def run(rows: Iterable[bytes]) -> list:
        if not tool:
            tool.append(Sizer(sent.value))
        found = [tool[0].judge(t, min_margin) for t in rows]
        return list(map(list, zip(*found, strict=True))) if found else [[], [], [], []]

    return annotate(docs, text_col, "_lang string, _score double, _margin double, _rejected boolean", run, keep_text)


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """`docs` without those that are rejected, learning from the rows outside the held-out fold."""
    docs, to, back = shielded(docs)
    learned = fit(docs.where(fold(to(id_col), 3) != 1), to(text_col), to(lang_col))
    return back(identify(docs, learned, to(text_col), keep_text=True).where("NOT _rejected"))


@query("op4_langid_compression")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learned = fit(docs.where(fold("doc_id", 3) != 1))
    rows = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return identify(rows, learned).select(
        "doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
        F.col("_margin").alias("margin"), F.col("_rejected").alias("rejected"),
    )
