"""Token counts that follow edits (operator 7).

A document's text is cut into pieces at lone spaces, across which pre-tokens never reach; each piece's token count is a
leaf of a segment tree whose nodes hold sums of characters, pieces and tokens. An edit finds the leaves that it touches by descent over
character sums, re-encodes only these and one neighbour on each side, and updates the sums on the paths to the root.
A document's tree lives while its row is worked on; edits travel with the row, so there is no state to lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identifier
from .tokens import Pieces, shared

#: Pieces of one leaf at first; edits change how many a leaf holds.
LEAF_PIECES = 8


class TokenTree:
    """Text of one document with the number of its tokens."""

    def __init__(self, text: str, pieces: Pieces):
        self.memo, self.recounted = pieces, 0
        parts = pieces.pieces(text) if text else []
        if parts is None:
            leaves = self._uneven(text)
        else:
            leaves = [" ".join(parts[k : k + LEAF_PIECES]) for k in range(0, len(parts), LEAF_PIECES)]
            leaves = [leaf if not k else " " + leaf for k, leaf in enumerate(leaves)]
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.texts = leaves + [""] * (self.size - len(leaves))
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, leaf in enumerate(leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = len(leaf), self._count(leaf)
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.recounted = 0

    @staticmethod
    def _lone(text: str, at: int) -> bool:
        """A space without white space beside it: a leaf may begin here."""
        return text[at] == " " and 0 < at < len(text) - 1 and not text[at - 1].isspace() and not text[at + 1].isspace()

    def _uneven(self, text: str) -> list[str]:
        cuts = [k for k in range(len(text)) if text[k] == " " and self._lone(text, k)][LEAF_PIECES - 1 :: LEAF_PIECES]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def _count(self, leaf: str) -> int:
        self.recounted += 1
        if not leaf:
            return 0
        if leaf[0] == " " and len(leaf) > 1:
            parts = self.memo.pieces(leaf[1:])
            if parts is not None:
                get = self.memo.__getitem__
                return sum(len(get(p)) for p in parts) >> 2
        return len(self.memo.whole(leaf)) >> 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, characters before it) for a character position below the total."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _neighbour(self, leaf: int, step: int) -> int | None:
        """The next leaf with text."""
        leaf += step
        while 0 <= leaf < self.size:
            if self.chars[self.size + leaf]:
                return leaf
            leaf += step
        return None

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        k = self.size + leaf
        self.texts[leaf], self.chars[k], self.tokens[k] = text, len(text), tokens
        k >>= 1
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k >>= 1

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace delete characters from at by insert; both ends are clamped to the text."""
        n = self.chars[1]
        at = min(max(at, 0), n)
        delete = min(max(delete, 0), n - at)
        if not n:
            self._set(0, insert, self._count(insert))
            return
        first, before = self._leaf_at(min(at, n - 1))
        last, _ = self._leaf_at(min(max(at, at + delete - 1), n - 1))
        low = self._neighbour(first, -1)  # boundary context: a cut at either edge may be gone after the edit
        high = self._neighbour(last, 1)
        if low is not None:
            before -= self.chars[self.size + low]
        low, high = first if low is None else low, last if high is None else high
        region = "".join(self.texts[low : high + 1])
        region = region[: at - before] + insert + region[at - before + delete :]
        # the region's own ends are intact lone spaces (or the text's ends), unless the edit reached them
        while high + 1 < self.size and (nxt := self._neighbour(high, 1)) is not None and not self._joins(region, self.texts[nxt]):
            region, high = region + self.texts[nxt], nxt
        while (prv := self._neighbour(low, -1)) is not None and (not region or not self._joins(self.texts[prv], region)):
            region, low = self.texts[prv] + region, prv
        self._set(low, region, self._count(region))
        for k in range(low + 1, high + 1):
            if self.texts[k]:
                self._set(k, "", 0)

    @staticmethod
    def _joins(left: str, right: str) -> bool:
        """The cut between two leaves is at a lone space."""
        return bool(left) and len(right) > 1 and right[0] == " " and not right[1].isspace() and not left[-1].isspace()


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_leaves", pa.int64()), ("n_recounted", pa.int64())])


def _run(tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(tokenizer)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                tree = TokenTree(text.as_py() or "", pieces)
                before, leaves = tree.total, sum(map(bool, tree.texts))
                for edit in edits.as_py() or ():
                    if edit is not None:
                        tree.edit(edit["at"] or 0, edit["delete"] or 0, edit["insert"] or "")
                rows.append((before, tree.total, leaves, tree.recounted))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in zip(*rows))] if rows else [batch.column(0), *(pa.array([], pa.int64()),) * 4], schema=_COUNTED)

    return run


def edit_counts(docs: DataFrame, edits: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_leaves, n_recounted; one row per input row.

    edits: a column array<struct<at, delete, insert>> over docs, or a table (doc_id, seq, at, delete, insert) whose
    rows apply to a document in order of seq. Positions are characters of the text as the edits before left it, clamped
    to it; null numbers are 0, a null insert is empty, a null edit is none. A null text is empty. n_recounted counts
    leaves encoded again. Edits of unknown documents are dropped; rows that repeat a doc_id all get its edits. An empty
    table gives an empty result; other columns play no part.
    """
    if isinstance(edits, DataFrame):
        own = edits.select(F.col("doc_id").cast("long").alias("edit_id"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"), F.col("delete").cast("long").alias("delete"), F.col("insert").cast("string").alias("insert")).alias("e"))
        listed = own.groupBy("edit_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["at"].alias("at"), e["delete"].alias("delete"), e["insert"].alias("insert"))).alias("edits"))
        slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
        rows = slim.join(listed, slim["doc_id"] == listed["edit_id"], "left").select("doc_id", "text", "edits")
    else:
        rows = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"), edits.cast("array<struct<at:long,delete:long,insert:string>>").alias("edits"))
    return rows.mapInArrow(_run(tokenizer), "doc_id long, n_tokens long, n_tokens_edited long, n_leaves long, n_recounted long")
