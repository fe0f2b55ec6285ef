"""Best-fit packing into sequences of several permitted lengths.

Documents become items of their token counts (longer ones are cut into pieces
of the greatest length). Every task packs its share by best fit, longest item
first: the open bin with the least room that still fits takes the item, of
equal ones the bin opened first. If none fits, all permitted lengths compete:
for each, the sizes still waiting say how full a bin of it would get, and so
how short it could end. A sequence of c tokens costs ``overhead`` + c +
c * c / ``attention`` (attention grows with the square), and the length of
least cost per token held is opened. At the end every bin shrinks to the
shortest permitted length that holds its contents.

Tasks get equal shares of the rows (a round-robin repartition, so no key can
be hot); how full bins get does not depend on their number once a share has a
few thousand items. A task sorts its items by size, id and start, so a retry
packs them alike, in whatever order they arrive.

Defined cases: documents without tokens (NULL, empty) form no piece and no
row; very long texts become as many pieces as they need; repeated rows and
equal ids are packed one by one; among items of equal size the least id comes
first, NULL ids (which are packed) before all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._shared import partitions_for, whole_partition
from ledgerlens.llm.source_mixing import token_count

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64  # cost of a sequence besides its tokens, in tokens
ATTENTION = 65_536  # tokens of a sequence whose attention costs as much as all else of them


def _filled(size: int, capacity: int, counts: Counter[int], waiting: int) -> int:
    """Tokens in a bin of ``capacity`` that holds ``size`` and then, again and
    again, the longest waiting piece that fits. ``waiting`` has a bit for each
    size in ``counts``."""
    room, below = capacity - size, capacity
    while room and below:
        fits = waiting & ((2 << min(room, below)) - 1)
        if not fits:
            break
        s = fits.bit_length() - 1
        room -= s * min(counts[s], room // s)
        below = s - 1
    return capacity - room


def pack(
    sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION,
) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """((item, start, length, bin, offset) of every piece; capacity of every
    bin). ``room`` has a bit for each amount of room that an open bin has."""
    lengths = tuple(sorted(set(lengths)))
    top = lengths[-1]
    pieces = [(min(top, s - at), i, at) for i, s in enumerate(sizes) for at in range(0, s, top)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    counts = Counter(p[0] for p in pieces)
    waiting = sum(1 << s for s in counts)
    shortest = lambda used: next(c for c in lengths if c >= used)

    def cost_per_token(size: int, capacity: int) -> float:
        used = _filled(size, capacity, counts, waiting)
        c = shortest(used)
        return (overhead + c + c * c / attention) / used

    room, by_room = 0, {}
    opened: list[int] = []
    used: list[int] = []
    out = []
    for size, item, start in pieces:
        counts[size] -= 1
        if not counts[size]:
            waiting ^= 1 << size
        fits = room >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = heappop(by_room[r])
            if not by_room[r]:
                room &= ~(1 << r)
        else:
            b = len(opened)
            r = min((c for c in lengths if c >= size), key=lambda c: (cost_per_token(size, c), c))
            opened.append(r)
            used.append(0)
        out.append((item, start, size, b, used[b]))
        used[b] += size
        if r > size:
            heappush(by_room.setdefault(r - size, []), b)
            room |= 1 << (r - size)
    return out, [shortest(u) for u in used]


def best_fit(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION,
    rows_per_task: int = 20_000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, piece (number of the piece in its document), start, length,
    bin, capacity, offset: token ranges of documents and their places."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("capacity", pa.int64()), ("offset", pa.int64())])
    top = max(lengths)

    def run(table: pa.Table) -> pa.Table:
        # by id, whatever the order of arrival; pack() sorts by size first
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        table = pa.concat_tables([table.filter(table.column(0).is_null()), table.filter(table.column(0).is_valid())])
        ids, sizes = table.column(0).to_pylist(), table.column(1).to_pylist()
        placed, capacity = pack(sizes, lengths, overhead, attention)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        cols = list(zip(*placed, strict=True)) or [()] * 5
        return pa.table(
            [
                pa.array([ids[i] for i in cols[0]], pa.int64()), pa.array([s // top for s in cols[1]], pa.int64()), pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()), pa.array([first + b for b in cols[3]], pa.int64()), pa.array([capacity[b] for b in cols[3]], pa.int64()),
                pa.array(cols[4], pa.int64()),
            ],
            schema=schema,
        )

    items = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), token_count(F.col(text)).alias("n")).filter("n > 0")
    tasks = partitions_for(docs.count(), rows_per_task)
    return items.repartition(tasks).mapInArrow(
        whole_partition(run, schema), "doc_id long, piece long, start long, length long, bin long, capacity long, offset long"
    )
