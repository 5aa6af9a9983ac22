"""Hierarchical multi-length packing of token sequences.

Rows are dealt to tasks as they lie in the input: packing needs no key, so it
needs no shuffle.  Inside a task, consecutive documents form cells of at least
``cell_tokens`` tokens (the last one may hold fewer); a cell is tokenised,
packed and emitted on its own, so memory is bounded by a cell and one document.

In a cell, with tiers 2048, 1024, 512, 256 (context sizes, powers of two):

1. Route.  A document gives as many whole windows of the largest tier as fit;
   the rest goes to the smallest tier that holds it.
2. Pack each tier, longest first: a rest opens a window of its tier; what the
   window has left is a gap.
3. Fill.  From the longest tier down, gaps take pieces of the documents of the
   shorter tiers, shortest first, cutting the last one so that the window is
   full.  So only the last window of a cell can have a gap; it is cut into
   windows of power-of-two sizes, the leftover of under ``min_tier`` tokens
   into powers of two as well, so no window needs padding.
4. Balance.  Windows go to step groups of about ``step_tokens`` tokens so that
   groups get alike amounts of attention work (sum of squared piece lengths):
   in snake order of their cost.

Each token of a document lies in exactly one piece.  Defined cases: a null or
empty text is a document of one end token; a null id is an id; repeated rows
are documents of their own; very long texts are cut into many windows; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import trimmed

SCHEMA = ("id long, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_tokens long, tier long, step_group long")
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary.

    ``json`` names the vocabulary for ``tokenizers``; where ``ranks`` names the
    same vocabulary as ranks, ``tiktoken`` encodes with it, with the same ids
    several times faster.  As ``tokenizers`` does, both give the string of a
    special token in a text that token's id.
    """

    json: str
    ranks: str | None = None
    pattern: str | None = None

    def encoder(self):
        if self.ranks:
            import tiktoken

            with open(self.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(self.json, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            ranks = {a: b for a, b in ranks.items() if b not in special.values()}
            enc = tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
            return lambda text: enc.encode_to_numpy(text, allowed_special="all")
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(self.json)
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)


def public_bpe_50k() -> Tokenizer:
    """The installed public vocabulary; evaluated where the task runs."""
    import public_tokenizers as p

    return Tokenizer(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_cell(lengths: list[int], tiers: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(document, start, length), ...]) of one cell."""
    tiers = sorted(tiers, reverse=True)
    top = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // top * top
        windows += [(top, [(d, s, top)]) for s in range(0, whole, top)]
        if n > whole:
            rest.append((d, whole, n - whole))
    # longest first: windows of long tiers are opened before the shorter rests that fill their gaps
    rest.sort(key=lambda p: (-p[2], p[0]))
    i, j = 0, len(rest) - 1  # rest[i] opens a window; rest[j], the shortest, is cut into gaps
    spare: tuple[int, int, int] | None = None
    while i <= j or spare:
        if i <= j:
            opener, i = rest[i], i + 1
        else:
            opener, spare = spare, None
        tier = min(t for t in tiers if t >= opener[2])
        pieces, gap = [opener], tier - opener[2]
        while gap and (spare or i <= j):
            if spare is None:
                spare, j = rest[j], j - 1
            d, s, n = spare
            take = min(gap, n)
            pieces.append((d, s, take))
            gap -= take
            spare = (d, s + take, n - take) if n > take else None
        if not gap:
            windows.append((tier, pieces))
        else:  # the cell's last window
            windows += split_powers(pieces)
    return windows


def split_powers(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces of a window with a gap, cut into full windows of powers of two."""
    out = []
    queue = list(pieces)
    for size in powers(sum(p[2] for p in pieces)):
        part, left = [], size
        while left:
            d, s, n = queue.pop(0)
            take = min(left, n)
            part.append((d, s, take))
            left -= take
            if n > take:
                queue.insert(0, (d, s + take, n - take))
        out.append((size, part))
    return out


def step_groups(costs: list[int], tokens: list[int], step_tokens: int) -> list[int]:
    """The step group of each window: snake order over falling cost."""
    groups = max(1, round(sum(tokens) / step_tokens))
    out = [0] * len(costs)
    for rank, w in enumerate(sorted(range(len(costs)), key=lambda w: (-costs[w], w))):
        turn, at = divmod(rank, groups)
        out[w] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer=public_bpe_50k, end_id: int = 1,
         tiers: tuple[int, ...] = (2048, 1024, 512, 256), cell_tokens: int = 1 << 20,
         step_tokens: int = 1 << 17) -> DataFrame:
    """One row per piece.  ``row`` numbers the documents of a task, so pieces of
    repeated ids stay apart; sequence and step group numbers hold the task's
    partition in their upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        encode = tokenizer().encoder()
        end = np.array([end_id], np.uint32)
        cell: list[tuple[int | None, np.ndarray]] = []
        held = seqs = steps = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal seqs, steps, rows
            windows = pack_cell([len(ids) for _, ids in cell], list(tiers))
            totals = [sum(n for _, _, n in ps) for _, ps in windows]
            groups = step_groups([sum(n * n for _, _, n in ps) for _, ps in windows], totals, step_tokens)
            cols: list[list] = [[] for _ in _ARROW]
            for w, (tier, pieces) in enumerate(windows):
                offset = 0
                for d, s, n in pieces:
                    doc, ids = cell[d]
                    for c, v in zip(cols, (doc, base + rows + d, s, n, zlib.crc32(ids[s:s + n]), len(ids), base + seqs + w,
                                           offset, totals[w], tier, base + steps + groups[w]), strict=True):
                        c.append(v)
                    offset += n
            seqs += len(windows)
            steps += max(groups, default=-1) + 1
            rows += len(cell)
            cell.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate((encode(text.as_py() or ""), end)).astype("<u4", copy=False)
                cell.append((doc.as_py(), ids))
                held += len(ids)
                if held >= cell_tokens:
                    yield flush()
                    held = 0
        if cell:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(trimmed(run), SCHEMA)
