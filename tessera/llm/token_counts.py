"""Token counts of a sentencepiece BPE model by prefix dynamic programming.

The pieces that a merge-by-rank encoder makes of a text are known by their neighbours alone: a row of
pieces is the encoding of its text if and only if every two neighbours are the encoding of theirs.
So the encoding of a prefix is that of a shorter prefix and one more piece, the only one that ends
there and agrees with the last piece of the shorter prefix, and one pass from left to right gives the
last piece and the token count of every prefix.  Which pieces agree is found by merging the two
texts, and remembered.  The counts at all prefixes are stored; a count is read off the last one, and
truncation and budgets are searches in them, with no second encoding of the text.

No piece of the model holds a space mark behind another character, so the pass starts anew at every
run of spaces, and what it found for such a unit holds wherever the unit occurs.  The model is checked
for that property, and for the ones that the pass takes for granted, when it is loaded; a model
without them is refused.  The library that made the model reads its pieces and encodes nothing.

Null texts count as empty (0 tokens).  Long texts are whole; repeated rows are counted each.  A
character outside the vocabulary counts one token for each of its UTF-8 bytes.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import id_text, python_stage, table

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct words whose last counts, and pairs of pieces whose agreement, a worker remembers before it starts afresh.
MEMO = 800_000


class Counter(dict):
    """word -> token count of a space and the word, the last cell of its programme."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece crosses a space: units can't be counted one by one")
        if any(c not in self.rank for piece in self.rank for c in piece) or any(model.is_unused(i) for i in range(model.get_piece_size())):
            raise ValueError("a piece holds a character that is none, or is not in use")
        if not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("the model has no pieces for bytes")
        probe = "a  é\nﬁ b "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes texts before it splits them")
        tails: dict[str, set[int]] = {}
        for piece in self.rank:
            if len(piece) > 2:
                tails.setdefault(piece[-3:], {1, 2}).add(len(piece))
        self.tails = {t: sorted(n, reverse=True) for t, n in tails.items()}  # lengths of the pieces that can end in three characters
        self.agreed: dict[tuple[str, str], bool] = {}

    def pieces(self, text: str) -> list[str]:
        """Merges by rank, the leftmost of equals first; for texts of a few characters."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, before: str, piece: str) -> bool:
        """Whether ``piece`` may stand behind ``before`` (empty: at the start)."""
        pair = (before, piece)
        if (known := self.agreed.get(pair)) is None:
            if len(self.agreed) >= MEMO:
                self.agreed.clear()
            known = self.agreed[pair] = self.pieces(before + piece) == ([before, piece] if before else [piece])
        return known

    def counted(self, unit: str) -> list[int]:
        """Token counts of the unit's prefixes: the last piece and the count of each from those of a shorter one."""
        rank, agreed, tails, short = self.rank, self.agreed, self.tails, (2, 1)
        last, counts = [""], [0]
        for k, c in enumerate(unit, 1):
            if c not in rank:  # nothing merges with it
                last.append("")
                counts.append(counts[-1] + len(c.encode("utf-8", "surrogatepass")))
                continue
            for n in tails.get(unit[k - 3 : k], short) if k > 2 else short:
                if n > k or (piece := unit[k - n : k]) not in rank:
                    continue
                fits = agreed.get((last[k - n], piece))
                if fits or fits is None and self.agree(last[k - n], piece):
                    last.append(piece)
                    counts.append(counts[k - n] + 1)
                    break
            else:
                raise ValueError("the model's merges are no ranking")
        return counts[1:]

    def __missing__(self, word: str) -> int:
        n = self.counted(MARK + word)[-1]
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def units(self, text: str) -> list[str]:
        return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str) -> int:
        """The count at the last prefix."""
        words = text.split(" ")
        if "" in words or MARK in text:  # a unit is more than one space and a word
            return sum([self[u[1:]] if u.count(MARK) == 1 else self.counted(u)[-1] for u in self.units(text)])
        return sum(map(self.__getitem__, words))

    def prefixes(self, text: str) -> "Prefixes":
        return Prefixes(self, text)


class Prefixes:
    """Stored counts at every prefix of one text: the place and count of each unit, and the counts inside it."""

    def __init__(self, counter: Counter, text: str):
        self.cells = [counter.counted(unit) for unit in counter.units(text)]
        self.chars, self.tokens = [0], [0]
        for cells in self.cells:
            self.chars.append(self.chars[-1] + len(cells))
            self.tokens.append(self.tokens[-1] + cells[-1])

    def at(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` characters."""
        if n_chars <= 0 or not self.cells:
            return 0
        place = min(n_chars + 1, self.chars[-1])  # the mark in front is a character
        k = bisect_right(self.chars, place) - 1
        rest = place - self.chars[k]
        return self.tokens[k] + (self.cells[k][rest - 1] if rest else 0)

    def longest(self, budget: int) -> int:
        """The most characters such that they take ``budget`` tokens at most."""
        k = min(bisect_right(self.tokens, budget), len(self.tokens)) - 1  # units that fit whole
        best = self.chars[k]
        for i in range(k, len(self.cells)):  # a prefix beyond may fit again; a unit's first piece takes one token at least
            if self.tokens[i] + 1 > budget:
                break
            fit = [n for n, cell in enumerate(self.cells[i], 1) if self.tokens[i] + cell <= budget]
            if fit:
                best = self.chars[i] + fit[-1]
        return max(0, best - 1)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _count(batches, path):
    import pyarrow as pa

    count = counter(path).count
    for batch in batches:
        n = [count(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(n, pa.int64())})


def _budget(batches, path, limit):
    import pyarrow as pa

    counts = counter(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        fit = [t[: counts.prefixes(t).longest(limit)] for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(fit, pa.string())})


def _table(batches, path):
    import pyarrow as pa

    counts = counter(path)
    for batch in batches:
        stored = [counts.prefixes(t) for t in batch.column("text").to_pylist()]
        cells = [[p.at(n) for n in range(1, p.chars[-1])] for p in stored]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "counts": pa.array(cells, pa.list_(pa.int32()))})


def _model(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text."""
    rows = id_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = dict(rows.dtypes)["doc_id"]
    return python_stage(rows, "tessera.llm.token_counts:_count", f"doc_id {kind}, n_bytes long, n_tokens long", _model(path))


def prefix_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts, the tokens of the first 1, 2, ... characters of each text."""
    rows = id_text(docs, id_col, text_col)
    return python_stage(rows, "tessera.llm.token_counts:_table", f"doc_id {dict(rows.dtypes)['doc_id']}, counts array<int>", _model(path))


def truncated(docs: DataFrame, limit: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the longest prefix of each text that fits ``limit`` tokens."""
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return python_stage(rows, "tessera.llm.token_counts:_budget", f"doc_id {kind}, text string", _model(path), limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)
