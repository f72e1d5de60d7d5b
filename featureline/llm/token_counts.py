"""Token counts of documents under a sentencepiece BPE model, by a two-tier lookup on the map side.

No merge of such a model crosses a border between other text and the space after it, if no piece has a space behind
another character (checked when the model is loaded). So the count of a text is the sum over its pre-tokens: a run of
spaces with what follows it up to the next space. Lengths of pre-tokens are looked up in two tiers: first in a table of
the corpus's frequent pre-tokens, which is broadcast; then in the worker's own cache, which holds what the worker had to
encode itself. No pre-token is shuffled but for the short lists of frequent ones, of which each task of the first pass
sends at most ``per_task``; ``table_entries`` bounds the table.

The table only saves work: counts are the same whatever it holds. Null texts count as empty; an empty text has no
tokens. Rows are independent of each other; an empty table gives an empty one. Other columns stay, but for those with
the names of results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featureline.llm.frames import fields

RESULT = T.StructType(fields("n_bytes long, n_tokens long"))
#: Entries of a worker's own cache, and of a task's counter before its rare half goes.
CACHE_ENTRIES = 300_000
#: Longer pre-tokens are neither counted nor kept.
MAX_KEPT = 48
_GAPS = re.compile(r"  |\A | \Z")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens without their first space; the text's first one has none before the model adds it."""
    text = text.replace("▁", " ")
    if not _GAPS.search(text):
        return text.split(" ")
    # The model puts a space before the text; then each run of spaces belongs to what follows.
    return [m[1:] for m in re.findall(r" +[^ ]*", " " + text)]


def _processor(model: bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
        raise ValueError("a piece goes on behind a space: texts can't be cut at spaces under this model")
    if len(sp.encode(" a  b ")) == len(sp.encode("a b")):
        raise ValueError("this model drops spaces")
    return sp


class Lengths(dict):
    """Tokens of a pre-token: what is in the table, and else what this worker has encoded."""

    def __init__(self, model: bytes, table: dict[str, int]):
        super().__init__(table)
        self.encode, self.table, self.most = _processor(model).encode, table, len(table) + CACHE_ENTRIES

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece)) if piece else self.spaces
        if len(piece) <= MAX_KEPT:
            if len(self) >= self.most:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n

    @property
    def spaces(self) -> int:
        # A lone space; the library has no tokens for an empty text, so it is counted as the difference it makes.
        return len(self.encode("a  b")) - len(self.encode("a b"))

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


_state: dict[int, Lengths] = {}


def frequent(docs: DataFrame, text: str, per_task: int, table_entries: int) -> list[str]:
    """The most frequent pre-tokens, by summing up each task's own list of its most frequent ones."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(pre_tokens(t.as_py() or ""))
                if len(seen) > CACHE_ENTRIES:
                    seen = Counter(dict(seen.most_common(CACHE_ENTRIES // 2)))
        best = [(w, n) for w, n in seen.most_common(per_task) if w and len(w) <= MAX_KEPT]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()),
                                          pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(top, "piece string, n long")
    best = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_entries)
    return [r.piece for r in best.select("piece").collect()]


def count_tokens(docs: DataFrame, model: str, *, text: str = "text", per_task: int = 4096,
                 table_entries: int = 32_768) -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens to every row; ``text`` is dropped.

    ``model`` is the path of a model file on the driver; its content (less than a MB) is broadcast with the table.
    """
    context = docs.sparkSession.sparkContext
    with open(model, "rb") as f:
        content = f.read()
    sp = _processor(content)
    words = frequent(docs, text, per_task, table_entries)
    shared = context.broadcast((content, {w: len(ids) for w, ids in zip(words, sp.encode(words))}))
    others = [c for c in docs.columns if c != text and c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in others] + RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if id(own) not in _state:
            _state.clear()
            _state[id(own)] = Lengths(*own)
        count = _state[id(own)].count
        for batch in batches:
            n_tokens = pa.array([count(t.as_py() or "") for t in batch.column("__featureline_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), batch.column("__featureline_bytes"), n_tokens],
                                             names=[*others, *RESULT.names])

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(*others, F.octet_length(whole).cast("long").alias("__featureline_bytes"), whole.alias("__featureline_text")) \
        .mapInArrow(run, schema)
