"""Edit-aware token counts (operator 7).

A document's pre-tokens are the leaves of a segment tree whose nodes sum characters and tokens. An edit finds its leaf
by character sums, takes the leaves it touches with two pre-tokens before them and some after, cuts that stretch anew
and stops at the first old boundary that is a boundary again with two pre-tokens beyond it (the pattern never looks
back, so all beyond is as it was). Only pre-tokens that are new there are encoded, and the sums up to the root follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, encoder, pretoken_spans
from .shared import small_batches
from .textkernel import batches, texts_of

_NONE = np.zeros(0, np.int64)
EDITS_TYPE = "array<struct<start:long,n_deleted:long,inserted:string>>"


class CountTree:
    """Pre-tokens of one text, with sums of their characters and tokens. A leaf is a pre-token of the text it was built from,
    or the pre-tokens that edits have put there; when those get more than SPLIT the tree is built anew, with a leaf for each."""

    SPLIT = 32

    def __init__(self, text: str, edges: np.ndarray, tokens: np.ndarray):
        """edges: where the text's pre-tokens begin, and its length; tokens: of each pre-token."""
        self.rebuilt = 0
        self._build(text, edges, tokens)

    def _build(self, text: str, edges: np.ndarray, tokens: np.ndarray) -> None:
        self.base, self.edges, self.tokens = text, edges, tokens
        self.put_in: dict[int, tuple[list[str], np.ndarray]] = {}
        self.n_leaves = max(len(tokens), 1)
        n = self.size = 1 << (self.n_leaves - 1).bit_length()
        self.tree = np.zeros((2 * n, 2), np.int64)  # characters, tokens
        if len(tokens):
            self.tree[n : n + len(tokens), 0] = np.diff(edges)
            self.tree[n : n + len(tokens), 1] = tokens
        while n > 1:
            self.tree[n // 2 : n] = self.tree[n : 2 * n : 2] + self.tree[n + 1 : 2 * n : 2]
            n //= 2

    @property
    def n_chars(self) -> int:
        return int(self.tree[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.tree[1, 1])

    def leaf(self, k: int) -> list[str]:
        """The pre-tokens of leaf k."""
        if k in self.put_in:
            return self.put_in[k][0]
        return [self.base[self.edges[k] : self.edges[k + 1]]] if len(self.tokens) else []

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one with text, if there is none), and where the leaf begins."""
        node, begin = 1, 0
        if at >= self.n_chars > 0:
            at = self.n_chars - 1
        while node < self.size:
            node *= 2
            left = int(self.tree[node, 0])
            if at - begin >= left:
                begin += left
                node += 1
        return min(node - self.size, self.n_leaves - 1), begin

    def put(self, leaf: int, pieces: list[str], tokens: np.ndarray) -> None:
        self.put_in[leaf] = (pieces, tokens)
        node = leaf + self.size
        change = (sum(map(len, pieces)) - int(self.tree[node, 0]), int(tokens.sum()) - int(self.tree[node, 1]))
        if change != (0, 0):
            while node:
                self.tree[node, 0] += change[0]
                self.tree[node, 1] += change[1]
                node >>= 1

    def split(self) -> None:
        """Give each pre-token a leaf of its own again. It costs as much as the whole text, but no encoding."""
        pieces, tokens, last = [], [], 0
        for k in sorted(self.put_in):
            pieces += [self.base[a:b] for a, b in zip(self.edges[last:k].tolist(), self.edges[last + 1 : k + 1].tolist())] + self.put_in[k][0]
            tokens += [self.tokens[last:k], self.put_in[k][1]]
            last = k + 1
        pieces += [self.base[a:b] for a, b in zip(self.edges[last:-1].tolist(), self.edges[last + 1 :].tolist())]
        tokens.append(self.tokens[last:])
        self.rebuilt += 1
        self._build("".join(pieces), np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]), np.concatenate(tokens).astype(np.int64))

    def text(self) -> str:
        out, last = [], 0
        for k in sorted(self.put_in):
            out += [self.base[self.edges[last] : self.edges[min(k, len(self.edges) - 1)]], *self.put_in[k][0]]
            last = min(k + 1, len(self.edges) - 1)
        return "".join(out) + self.base[self.edges[last] :]


class _Edit:
    """One edit of one tree: the stretch to cut anew, and the old leaf boundaries behind the edit."""

    def __init__(self, tree: CountTree, start: int, n_deleted: int, inserted: str):
        self.tree = tree
        start = min(max(start, 0), tree.n_chars)
        stop = min(start + max(n_deleted, 0), tree.n_chars)
        self.low, begin = tree.find(start)
        before = 0
        while self.low and before < 3:
            self.low -= 1
            begin -= int(tree.tree[tree.size + self.low, 0])
            before += len(tree.leaf(self.low))
        self.high = tree.find(stop)[0] + 1
        self.reach, self.begin, self.start, self.stop, self.inserted = 4, begin, start, stop, inserted

    def stretch(self) -> str:
        """The stretch of the new text, from leaf low to leaf end."""
        leaf = self.tree.leaf
        pieces, end = 0, self.high
        while end < self.tree.n_leaves and pieces < self.reach:
            pieces += len(leaf(end))
            end += 1
        old = "".join(p for k in range(self.low, end) for p in leaf(k))
        self.end = end
        return old[: self.start - self.begin] + self.inserted + old[self.stop - self.begin :]

    def settle(self, text: str, starts: set[int]) -> bool:
        """Find the first old boundary behind the edit that holds; False: the stretch is too short to tell."""
        n = self.tree.n_leaves
        if self.end == n:
            self.until, self.cut = self.end, len(text)
        at, beyond = len(text), 0
        found = self.end == n
        for k in range(self.end - 1, self.high - 1, -1):
            at -= int(self.tree.tree[self.tree.size + k, 0])
            beyond += len(self.tree.leaf(k))
            if beyond >= 2 and at in starts and at >= self.start - self.begin + len(self.inserted):
                self.until, self.cut, found = k, at, True
        self.reach *= 4
        return found


def apply_edits(bpe: ByteBPE, trees: list[CountTree], edits: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Apply each tree's edits one after the other (each counts characters of the text as it is then; what lies beyond its
    end is clipped). Returns the number of pre-tokens encoded anew for each tree."""
    again = np.zeros(len(trees), np.int64)
    for r in range(max(map(len, edits), default=0)):
        todo = [(k, _Edit(trees[k], *edits[k][r])) for k in range(len(trees)) if len(edits[k]) > r]
        while todo:
            texts = [e.stretch() for _, e in todo]
            data, begin, end, at, char_at = pretoken_spans(texts)
            start_row, count = bpe.cache.rows(data, begin, end)
            base = np.cumsum([0] + [len(t) for t in texts])
            rest = []
            for x, (k, e) in enumerate(todo):
                a, b = int(at[x]), int(at[x + 1])
                starts = (char_at[a:b] - base[x]).tolist()
                if not e.settle(texts[x], set(starts)):
                    rest.append((k, e))
                    continue
                m = sum(s < e.cut for s in starts)
                edges = starts[:m] + [e.cut]
                pieces = [texts[x][edges[i] : edges[i + 1]] for i in range(m)]
                tree = e.tree
                for leaf in range(e.low + 1, e.until):
                    tree.put(leaf, [], _NONE)
                tree.put(e.low, pieces, count[a : a + m])
                if m > tree.SPLIT:
                    tree.split()
                again[k] += m
            todo = rest
    return again


def count_with_edits(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Tokens of every whole text before and after its edits (edits_col: EDITS_TYPE).

    Returns the id column, n_chars, n_tokens, n_pretokens, n_edits, edited_chars, edited_tokens, n_encoded (pre-tokens
    that the edits had encoded). Null texts count as empty, null edits as none, null members of an edit as 0
    or empty; positions beyond the text are clipped. Rows are independent, so repeats and null ids stay; other columns are
    dropped, whatever their names. An empty table gives an empty table."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_chars", "n_tokens", "n_pretokens", "n_edits", "edited_chars", "edited_tokens", "n_encoded"]

    def run(it):
        bpe = encoder(path)
        for batch in it:
            for i, j in batches(batch.column(1)):
                part = batch.slice(i, j - i)
                texts = texts_of(part.column(1))
                data, begin, end, at, char_at = pretoken_spans(texts)
                count = bpe.cache.rows(data, begin, end)[1]
                base = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
                edits = [[(e["start"] or 0, e["n_deleted"] or 0, e["inserted"] or "") for e in x or [] if e] for x in part.column(2).to_pylist()]
                trees = []
                for k in range(len(texts)):
                    a, b = int(at[k]), int(at[k + 1])
                    trees.append(CountTree(texts[k], np.append(char_at[a:b], base[k + 1]) - base[k], count[a:b]))
                before = [t.n_tokens for t in trees]
                again = apply_edits(bpe, trees, edits)
                out = [[len(t) for t in texts], before, np.diff(at).tolist(), [len(e) for e in edits], [t.n_chars for t in trees], [t.n_tokens for t in trees], again.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in out)], names=[id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col).cast("string"), F.col(edits_col).cast(EDITS_TYPE)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))
