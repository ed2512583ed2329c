"""Exact deduplication by Patricia-trie owners.

Map side: each task inserts its normalised texts into a radix trie, so that of
equal texts in a task one representative goes on.  Then representatives are dealt
by text length and content hash; each partition inserts their full byte strings
into a radix trie whose terminal nodes hold the smallest identifier and the
number of rows.  Equality is decided by the tries alone; the hash only deals.
A terminal holds one owner, whatever number of rows it stands for.  A trie that
outgrows its budget spills whole subtrees to temporary files of its task and finishes
them one after the other.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, utf8, written

#: Bytes that one trie holds before it spills (or, map side, is handed on): texts, nodes and owners.
BUDGET = 64 << 20
#: About what a node takes beside its label, and an owner beside what it carries.
NODE, OWNER = 300, 200
#: Files that a trie spills to at most; further subtrees share them.
FILES = 64
#: Bytes of text in a batch of rows that are handed on.
_BATCH = 8 << 20


def normalised(text: bytes) -> bytes:
    """Every run of ASCII white space becomes one space; ends are kept as a space."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    if text[:1].isspace():
        body = b" " + body
    return body + b" " if text[-1:].isspace() else body


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """A compressed edge and what hangs below it; ``owner`` marks a terminal."""

    __slots__ = ("label", "below", "owner", "held")

    def __init__(self, label: bytes, owner=None) -> None:
        self.label = label
        self.below: dict[int, Node] = {}
        self.owner = owner
        self.held = len(label) + NODE


class Trie:
    """Radix trie over byte strings; ``held`` of a node counts bytes at and below it."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.path: list[Node] = []

    def find(self, text: bytes) -> Node:
        """The terminal node of text, made if it is new."""
        node, at, size = self.root, 0, len(text)
        self.path = path = [node]
        while at < size:
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                self.grow(child.held)
                path.append(child)
                return child
            label = child.label
            if text.startswith(label, at):
                at += len(label)
                node = child
                path.append(node)
                continue
            n = _common(label, text, at)
            upper = Node(label[:n])
            child.label = label[n:]
            child.held -= n
            upper.held += child.held
            upper.below[child.label[0]] = child
            node.below[text[at]] = upper
            self.grow(NODE)
            at += n
            node = upper
            path.append(node)
        return node

    def grow(self, n: int) -> None:
        """Count n more bytes for all nodes on the way to the terminal found last."""
        for x in self.path:
            x.held += n

    @property
    def held(self) -> int:
        return self.root.held

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """(text, node) of all terminals at or below node."""
        stack = [(self.root if node is None else node, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.owner is not None:
                yield whole, node
            stack += [(child, whole) for child in node.below.values()]

    def heaviest(self) -> tuple[bytes, Node, int] | None:
        """(prefix, branching node, first byte) of the largest subtree below the first branching."""
        node, prefix = self.root, b""
        while len(node.below) == 1 and node.owner is None:
            (node,) = node.below.values()
            prefix += node.label
        if not node.below:
            return None
        return prefix, node, max(node.below, key=lambda b: node.below[b].held)


def owners(
    records: Iterator[tuple], merge: Callable, weight: Callable = lambda owner: OWNER, budget: int = BUDGET
) -> Iterator[tuple]:
    """(text, owner) for each distinct text of (text, entry) records, within the budget.

    merge(owner or None, entry) gives the text's new owner and an event or None; events
    come out at once as (None, event).  When the trie outgrows the budget, its heaviest
    subtree goes to a temporary file, and so do later records of that subtree; each file
    is then treated alike.
    """
    with tempfile.TemporaryDirectory() as folder:
        yield from _owned(((t, e, False) for t, e in records), merge, weight, budget, folder)


def _owned(records: Iterator[tuple], merge: Callable, weight: Callable, budget: int, folder: str) -> Iterator[tuple]:
    trie = Trie()
    spilled: dict[bytes, object] = {}
    files: list = []
    lengths: list[int] = []
    for text, entry, merged in records:
        if spilled:
            out = next((spilled[text[:n]] for n in lengths if text[:n] in spilled), None)
            if out is not None:
                pickle.dump((text, entry, merged), out)
                continue
        node = trie.find(text)
        before = 0 if node.owner is None else weight(node.owner)
        node.owner, event = (entry, None) if merged else merge(node.owner, entry)
        if event is not None:
            yield None, event
        trie.grow(weight(node.owner) - before)
        while trie.held > budget and (found := trie.heaviest()) is not None:
            prefix, top, first = found
            branch = top.below.pop(first)
            if len(files) < FILES:
                handle, path = tempfile.mkstemp(dir=folder)
                os.close(handle)
                files.append(open(path, "wb"))
            out = spilled[prefix + bytes([first])] = files[len(spilled) % FILES]
            lengths = sorted({len(m) for m in spilled}, reverse=True)
            for whole, gone in trie.terminals(branch, prefix):
                pickle.dump((whole, gone.owner, True), out)
            freed, node, at = branch.held, trie.root, 0
            node.held -= freed
            while node is not top:
                node = node.below[prefix[at]]
                at += len(node.label)
                node.held -= freed
    for whole, node in trie.terminals():
        yield whole, node.owner
    del trie, spilled
    paths = [f.name for f in files]
    for f in files:
        f.close()
    for path in paths:
        with open(path, "rb") as f:
            yield from _owned(_loaded(f), merge, weight, budget, folder)
        os.remove(path)


def _loaded(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _smaller(a: tuple, b: tuple) -> tuple:
    """Of two (key, row): the smaller key, null last, then the smaller row number."""
    if (a[0] is None) != (b[0] is None):
        return b if a[0] is None else a
    if a[0] is None:
        return a if a[1] <= b[1] else b
    return a if a <= b else b


def duplicate_groups(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, budget: int = BUDGET
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256[, carried columns]) for every row.

    Texts are equal when identical after each run of ASCII white space is replaced
    by one space; null counts as empty.  keep_id is the smallest key of the group
    (null keys come last) and ``kept`` marks exactly one row of it: rows that repeat
    a key and a text count as copies.  An empty table gives an empty result.  Other
    columns are read only if named in ``carry``.  ``budget``: bytes that a trie holds.
    """
    prepare(documents.sparkSession)
    carried = carry or []
    slim = documents.select(
        F.col(key).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col(text).alias("text")
    )
    kind = slim.schema["key"].dataType.simpleString()
    extra = [f"c{i}" for i in range(len(carried))]
    extras = "".join(f", {c} {slim.schema[c].dataType.simpleString()}" for c in extra)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    local_schema = f"rep long, key {kind}, row long, n long, content binary{extras}"
    local_arrow = to_arrow_schema(_parse_datatype_string(local_schema))
    owner_schema = f"part long, rep long, keep_id {kind}, keep_row long, group_size long, text_sha256 string"
    owner_arrow = to_arrow_schema(_parse_datatype_string(owner_schema))

    def localise(batches):
        """Member rows (n is null) and, per distinct text of the task, a class row with the text."""
        base = TaskContext.get().partitionId() << 33
        row, classes, trie = base, base, Trie()

        def class_rows():
            for part in _batches((whole, node.owner) for whole, node in trie.terminals()):
                fields = [
                    [o[0] for _, o in part],
                    [o[1][0] for _, o in part],
                    [o[1][1] for _, o in part],
                    [o[2] for _, o in part],
                    [w for w, _ in part],
                ]
                columns = [pa.array(v, type=f.type) for v, f in zip(fields, local_arrow)]
                columns += [pa.nulls(len(part), type=f.type) for f in list(local_arrow)[5:]]
                yield pa.RecordBatch.from_arrays(columns, schema=local_arrow)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            reps = []
            for k, raw in zip(batch.column("key").to_pylist(), utf8(batch.column("text"))):
                node = trie.find(normalised(raw))
                if node.owner is None:
                    node.owner = [classes, (k, row), 1]
                    classes += 1
                    trie.grow(OWNER)
                else:
                    owner = node.owner
                    owner[1] = _smaller(owner[1], (k, row))
                    owner[2] += 1
                reps.append(node.owner[0])
                row += 1
            columns = [
                pa.array(reps, pa.int64()),
                batch.column("key").cast(local_arrow.field("key").type),
                pa.array(range(row - n, row), pa.int64()),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.binary()),
                *[batch.column(c).cast(local_arrow.field(c).type) for c in extra],
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=local_arrow)
            if trie.held > budget:
                yield from class_rows()
                trie = Trie()
        yield from class_rows()

    local = written(slim.mapInArrow(localise, local_schema), "exact")
    classes = local.where("n is not null").select("rep", "key", "row", "n", "content")
    dealt = classes.repartition(F.length("content"), F.xxhash64("content"))

    def own(batches):
        """Per class row its text's number, at once; then, per text, what its trie's terminal holds."""
        texts = TaskContext.get().partitionId() << 33

        def records():
            for batch in batches:
                for rep, k, row, n, content in zip(*[c.to_pylist() for c in batch.columns]):
                    yield content, (rep, k, row, n)

        def merge(owner, entry):
            nonlocal texts
            rep, k, row, n = entry
            if owner is None:
                owner, texts = (texts, k, row, n), texts + 1
            else:
                owner = (owner[0], *_smaller(owner[1:3], (k, row)), owner[3] + n)
            return owner, (owner[0], rep)

        def rows():
            for content, found in owners(records(), merge, budget=budget):
                if content is None:
                    yield (*found, None, None, None, None)
                else:
                    yield found[0], None, *found[1:], hashlib.sha256(content).hexdigest()

        held: list[tuple] = []
        for r in rows():
            held.append(r)
            if len(held) >= 5000:
                yield _batch_of(held, owner_arrow)
                held = []
        if held:
            yield _batch_of(held, owner_arrow)

    owned = written(dealt.mapInArrow(own, owner_schema), "exact-owned")
    texts = owned.where("rep is null").drop("rep")
    by_rep = owned.where("rep is not null").select("part", "rep").join(texts, "part").drop("part")
    members = local.where("n is null").select("rep", "key", "row", *extra)
    return members.join(by_rep, "rep").select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
        *[F.col(c).alias(name) for c, name in zip(extra, carried)],
    )


def _batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _batches(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of (text, owner) with up to 2000 items and about _BATCH bytes of text."""
    part, size = [], 0
    for item in items:
        part.append(item)
        size += len(item[0])
        if len(part) >= 2000 or size >= _BATCH:
            yield part
            part, size = [], 0
    if part:
        yield part


def deduplicate(documents: DataFrame, *, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One whole row, all columns unchanged, of each group of equal texts.

    The row with the smallest key stays (null keys come last; of rows that repeat
    key and text one stays).  Same method as duplicate_groups, with a single shuffle:
    the owner in the trie is the row itself.
    """
    prepare(documents.sparkSession)
    columns = documents.columns
    at_key, at_text = columns.index(key), columns.index(text)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    plain = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    out_schema = plain.schema
    dealt_schema = StructType([*out_schema.fields]).add("row", LongType()).add("length", LongType()).add("mark", LongType())
    out_arrow, dealt_arrow = to_arrow_schema(out_schema), to_arrow_schema(dealt_schema)

    def carried(values: tuple) -> int:
        return OWNER + sum(len(v) if isinstance(v, (str, bytes)) else 32 for v in values)

    def localise(batches):
        row, trie = TaskContext.get().partitionId() << 33, Trie()

        def class_rows():
            for part in _batches((content, node.owner) for content, node in trie.terminals()):
                rows = []
                for content, (rank, values) in part:
                    mark = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big", signed=True)
                    rows.append((*values, rank[1], len(content), mark))
                yield _batch_of(rows, dealt_arrow)

        for batch in batches:
            fields = [c.to_pylist() for c in batch.columns]
            for raw, values in zip(utf8(batch.column(at_text)), zip(*fields)):
                node, rank = trie.find(normalised(raw)), (values[at_key], row)
                if node.owner is None:
                    node.owner = (rank, values)
                    trie.grow(carried(values))
                elif _smaller(node.owner[0], rank) is rank:
                    trie.grow(carried(values) - carried(node.owner[1]))
                    node.owner = (rank, values)
                row += 1
                if trie.held > budget:
                    yield from class_rows()
                    trie = Trie()
        yield from class_rows()

    def own(batches):
        def records():
            for batch in batches:
                raw = utf8(batch.column(at_text))
                for content, values in zip(raw, zip(*[c.to_pylist() for c in batch.columns])):
                    yield normalised(content), values

        def merge(owner, values):
            if owner is None:
                return values, None
            a, b = (owner[at_key], owner[len(columns)]), (values[at_key], values[len(columns)])
            return (owner if _smaller(a, b) is a else values), None

        for part in _batches(owners(records(), merge, carried, budget)):
            yield _batch_of([values[: len(columns)] for _, values in part], out_arrow)

    dealt = plain.mapInArrow(localise, dealt_schema).repartition("length", "mark")
    return dealt.mapInArrow(own, out_schema).toDF(*columns)
