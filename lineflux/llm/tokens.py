"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table with the token counts of frequent pre-tokens; tier two is a bounded cache in each worker that
encodes what the table misses. No pre-token is shuffled and no count depends on either tier's content.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

MODEL = "piece_bpe_32k.model"
#: Entries of the broadcast table; with pre-tokens of 32 characters at most this is about 3 MB.
FREQUENT = 32_768
LONGEST_FREQUENT = 32
#: Documents that the table's candidates are counted in. Only speed depends on them.
SAMPLE_DOCS, SAMPLE_TOKENS = 1_000, 2_000
#: Entries of a worker's cache (about 150 bytes each); it is emptied when full.
CACHE = 400_000
#: Pre-tokens longer than this are encoded without being cached.
LONGEST_CACHED = 64


class Counts(dict):
    """Token counts of pre-tokens, encoding what is missing.

    A pre-token is a stretch without spaces, encoded with the mark of the space before it. This is exact where no piece of
    the vocabulary holds the mark after another character; splits() checks the vocabulary for that.
    """

    def __init__(self, path: str, known: dict[str, int] | None = None, most: int = CACHE):
        import sentencepiece

        super().__init__(known or {})
        self.known, self.most = known or {}, most
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def splits(self) -> bool:
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        return not any("▁" in p.lstrip("▁") for p in pieces)

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word))
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.clear()
                self.update(self.known)
            self[word] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or text[-1] == " " or "▁" in text or "\0" in text:
            return self.runs(text)
        return sum(map(self.__getitem__, text.split(" ")))

    def runs(self, text: str) -> int:
        """As of(), where spaces come in runs: a run and the stretch after it are one pre-token, but spaces in a long
        run merge with each other, so such a text is cut only at single spaces between other characters."""
        if "▁" in text or "\0" in text:
            return len(self.model.encode(text))
        total, held = 0, []
        for word in text.split(" "):
            if word and held and held[-1]:
                total += self.piece(held)
                held = [word]
            else:
                held.append(word)
        return total + self.piece(held)

    def piece(self, words: list[str]) -> int:
        return self[words[0]] if len(words) == 1 else len(self.model.encode(" ".join(words)))


def frequent(docs: DataFrame, text: str = "text", *, sample: int = SAMPLE_DOCS, most: int = FREQUENT) -> list[str]:
    """The most frequent short pre-tokens of `sample` documents; a bounded list. Counts do not depend on it."""
    # take() reads as few partitions as it needs; each document gives a bounded array
    seen = Counter()
    for r in docs.where(F.col(text).isNotNull()).select(F.slice(F.split(text, " "), 1, SAMPLE_TOKENS).alias("w")).take(sample):
        seen.update(w for w in r.w if len(w) <= LONGEST_FREQUENT)
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]]


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text, as the library counts it.

    A null or empty text has none. Rows map to rows: ties and repeated rows count alike, an empty table gives no rows, other
    columns are ignored. path is the SentencePiece model, readable on every node.
    """
    table_ = {}
    ship(docs.sparkSession)
    counts = Counts(path)
    whole = not counts.splits()
    if not whole:
        table_ = {w: len(counts.model.encode(w)) for w in frequent(docs, sample=sample)}
    known = docs.sparkSession.sparkContext.broadcast(table_)

    def rows(batches):
        import pyarrow as pa

        c = Counts(path, known.value)
        of = (lambda t: len(c.model.encode(t))) if whole else c.of
        for batch in batches:
            n = [of(t) if t else 0 for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return slim.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
