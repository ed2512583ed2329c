"""Element trees: ancestry, outlines, siblings, sections, reconstruction."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_scratch


def labels(elements: DataFrame) -> DataFrame:
    """(doc_id, element_id, parent_id, pre, last, depth, ancestor_ids, placed): numbers that turn ancestry into ranges.

    elements: doc_id, position, element_id, parent_id, in document order, which is parents
    before their children and no subtree cut in two.  pre numbers a document's elements,
    last is the largest number in the element's subtree: x lies below y if y.pre < x.pre
    <= y.last.  ancestor_ids starts with the parent.  A parent that is not there is an
    ancestor all the same; an element that is its own parent is a root.  Where order is
    violated, placed is false, and the element counts as one whose parent is not there.

    One shuffle by document, whatever the depth; a task streams its rows and holds the
    ancestors of the current one only.
    """
    kinds = {c: elements.schema[c].dataType.simpleString() for c in ("doc_id", "element_id", "parent_id")}
    schema = (
        ", ".join(f"{c} {k}" for c, k in kinds.items())
        + f", pre long, last long, depth int, ancestor_ids array<{kinds['parent_id']}>, placed boolean"
    )
    names = ["doc_id", "element_id", "parent_id", "pre", "last", "depth", "ancestor_ids", "placed"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = object()
        stack: list[tuple] = []  # (id, parent, pre, placed); pre is None for a parent that is not there
        at, n, out, types = {}, 0, [], None

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                own, parent, pre, placed = stack.pop()
                at.pop(own, None)
                if pre is not None:
                    above = [e[0] for e in reversed(stack)]
                    out.append((doc, own, parent, pre, n - 1, len(above), above, placed))

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if types is None:
                own = [batch.schema.field(c).type for c in ("doc_id", "element_id", "parent_id")]
                types = [*own, pa.int64(), pa.int64(), pa.int32(), pa.list_(own[2]), pa.bool_()]
            for d, own, parent in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "element_id", "parent_id")]):
                if d != doc:
                    close(0)
                    doc, n = d, 0
                root = parent is None or parent == own
                known = not root and parent in at
                placed = root or known and stack[at[parent]][2] is not None
                close(at[parent] + 1 if known else 0)
                if not root and not known:
                    at[parent] = 0
                    stack.append((parent, None, None, False))
                at[own] = len(stack)
                stack.append((own, parent, n, placed))
                n += 1
                if len(out) >= 10_000:
                    yield flushed()
        close(0)
        if out:
            yield flushed()

    held = elements.select("doc_id", "position", "element_id", "parent_id").repartition("doc_id")
    return held.sortWithinPartitions("doc_id", "position", "element_id").mapInArrow(walk, schema)


def ancestry(elements: DataFrame, depth: int | None = None) -> DataFrame:
    """(element_id, ancestor_ids): ancestors from the parent up to the root.

    Elements with doc_id and position in document order are walked once.  Others, and
    those whose parent stands elsewhere, join their topmost known ancestor's parent each
    round; that walk ends when no row grew, at ``depth`` rounds if given, or where an
    ancestor would repeat.
    """
    shared_scratch(elements.sparkSession)
    if depth is None and {"doc_id", "position"} <= set(elements.columns):
        labelled = labels(elements).checkpoint()
        late = labelled.where("NOT placed").select(F.col("parent_id").alias("up"))
        if late.join(elements.select(F.col("element_id").alias("up")), "up", "left_semi").isEmpty():
            return labelled.select("element_id", "ancestor_ids")
    return _climbed(elements, depth)


def _climbed(elements: DataFrame, depth: int | None) -> DataFrame:
    kind = elements.schema["parent_id"].dataType.simpleString()
    links = elements.where("parent_id IS NOT NULL").select(F.col("element_id").alias("child"), F.col("parent_id").alias("up"))
    paths = elements.select("element_id", F.array().cast(f"array<{kind}>").alias("ancestor_ids"), F.col("element_id").alias("top"))
    done = None
    for _ in count() if depth is None else range(depth):
        step = paths.join(links, paths["top"] == links["child"], "left")
        grown = F.col("up").isNotNull() & ~F.array_contains("ancestor_ids", F.col("up")) & (F.col("up") != F.col("element_id"))
        step = step.select(
            "element_id",
            F.when(grown, F.concat("ancestor_ids", F.array("up"))).otherwise(F.col("ancestor_ids")).alias("ancestor_ids"),
            F.when(grown, F.col("up")).alias("top"),
        ).checkpoint()
        ended = step.where("top IS NULL").select("element_id", "ancestor_ids")
        done = ended if done is None else done.union(ended)
        paths = step.where("top IS NOT NULL")
        if paths.isEmpty():
            return done
    return done.union(paths.select("element_id", "ancestor_ids"))


def descendants(labelled: DataFrame, of: DataFrame) -> DataFrame:
    """(ancestor_id, element_id, steps): all elements below each of the given ones (element_id), by ranges inside documents."""
    top = labelled.join(of.select("element_id").distinct(), "element_id", "left_semi").select(
        F.col("doc_id").alias("__doc"), F.col("element_id").alias("ancestor_id"), F.col("pre").alias("__pre"), F.col("last").alias("__last"), F.col("depth").alias("__depth")
    )
    below = (F.col("doc_id") == F.col("__doc")) & (F.col("pre") > F.col("__pre")) & (F.col("pre") <= F.col("__last"))
    return labelled.join(top, below).select("ancestor_id", "element_id", (F.col("depth") - F.col("__depth")).alias("steps"))


def outline(hits: DataFrame, elements: DataFrame) -> DataFrame:
    """(element_id, score): all hits and all their ancestors; ancestors that are no hits have no score."""
    paths = ancestry(elements).join(hits.select("element_id"), "element_id", "left_semi")
    nodes = paths.select(F.explode("ancestor_ids").alias("element_id")).union(hits.select("element_id")).distinct()
    return nodes.join(hits.select("element_id", "score"), "element_id", "left")


def siblings(elements: DataFrame) -> DataFrame:
    """(source_id, relationship_type, target_reference): next and previous sibling by position."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("position", "element_id")
    near = elements.where("parent_id IS NOT NULL").select(
        "element_id", F.lead("element_id").over(w).alias("next_sibling"), F.lag("element_id").over(w).alias("previous_sibling")
    )
    return near.unpivot("element_id", ["next_sibling", "previous_sibling"], "relationship_type", "target_reference").where(
        "target_reference IS NOT NULL"
    ).withColumnRenamed("element_id", "source_id")


def containment(elements: DataFrame) -> DataFrame:
    """contains and contained_by edges of every parent."""
    child = elements.where("parent_id IS NOT NULL")
    down = child.select(F.col("parent_id").alias("source_id"), F.lit("contains").alias("relationship_type"), F.col("element_id").alias("target_reference"))
    up = child.select(F.col("element_id").alias("source_id"), F.lit("contained_by").alias("relationship_type"), F.col("parent_id").alias("target_reference"))
    return down.union(up)


def sectioned(elements: DataFrame, levels: int = 6) -> DataFrame:
    """The elements with section_id: the nearest header above whose level is lower (any header, for other elements).

    For each level the last header of that level before the row is known by a window;
    it is open if no header of the same or a lower level came after it.
    """
    w = Window.partitionBy("doc_id").orderBy("position", "element_id").rowsBetween(Window.unboundedPreceding, -1)
    header = F.col("element_type") == "header"
    out = elements
    for n in range(1, levels + 1):
        seen = F.last(F.when(header & (F.col("level") == n), F.struct("position", "element_id")), ignorenulls=True).over(w)
        out = out.withColumn(f"__h{n}", seen)
    chosen = F.lit(None).cast("struct<position:int,element_id:string>")
    for n in range(1, levels + 1):
        last = F.col(f"__h{n}")
        above = chosen["position"]
        open_ = last.isNotNull() & (above.isNull() | (last["position"] > above)) & (~header | (F.col("level") > n))
        chosen = F.when(open_, last).otherwise(chosen)
    return out.select(*elements.columns, chosen["element_id"].alias("section_id"))


def sections(elements: DataFrame, levels: int = 6) -> DataFrame:
    """(element_id, section_id) of ``sectioned``."""
    return sectioned(elements, levels).select("element_id", "section_id")


def neighbours(elements: DataFrame, before: int, after: int) -> DataFrame:
    """(element_id, predecessors, successors): the nearest elements with text in document order."""
    w = Window.partitionBy("doc_id").orderBy("position", "element_id")
    rows = elements.where("element_type <> 'root' AND trim(text) <> ''")
    return rows.select(
        "element_id",
        F.collect_list("element_id").over(w.rowsBetween(-before, -1)).alias("predecessors"),
        F.collect_list("element_id").over(w.rowsBetween(1, after)).alias("successors"),
    )


def within_budget(elements: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """Elements of each document, in order, while their running token sum stays in the budget."""
    w = Window.partitionBy("doc_id").orderBy("position", "element_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return elements.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def cut_to_budget(elements: DataFrame, tokens: Column, budget: int, least: int = 50) -> DataFrame:
    """Elements of each document, in order, up to the first that does not fit the budget, with the column taken.

    taken is the element's tokens; the first that does not fit is cut to what is left, if
    that is over ``least``.
    """
    w = Window.partitionBy("doc_id").orderBy("position", "element_id")
    before = F.coalesce(F.sum("__tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = elements.withColumn("__tokens", tokens).withColumn("__before", before)
    # the running sum grows, so only the first miss starts within the budget
    left = F.lit(budget) - F.col("__before")
    taken = F.when(F.col("__tokens") <= left, F.col("__tokens")).when(left > least, left)
    return seen.withColumn("taken", taken).where("taken IS NOT NULL").drop("__tokens", "__before")


def first_children(elements: DataFrame, most: int) -> DataFrame:
    """(element_id, children): the ids of the first ``most`` children of each element that have text, in order."""
    rows = elements.where("parent_id IS NOT NULL AND trim(text) <> ''")
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("position", "element_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "element_id"))), lambda x: x["element_id"])
    return few.groupBy(F.col("parent_id").alias("element_id")).agg(listed.alias("children"))


def contexts(elements: DataFrame, before: int = 1, after: int = 1, children: int = 3) -> DataFrame:
    """(element_id, text, parents, siblings, children): each element's text with those around it, as arrays of texts.

    parents from the nearest up, siblings the nearest elements before and after in the
    document, children the first with text; empty texts and roots are left out.  Elements
    in document order are walked once, after a check of their ids; others are joined.
    """
    shared_scratch(elements.sparkSession)
    late = _late_parents(elements).distinct().checkpoint()
    if late.isEmpty() or late.join(elements.select(F.col("element_id").alias("up")), "up", "left_semi").isEmpty():
        return _contexts_walked(elements, before, after, children)
    return _contexts_joined(elements, before, after, children)


def _in_order(elements: DataFrame, *columns: str | Column) -> DataFrame:
    """doc_id and columns, documents side by side in order: a window lays them so, without a shuffle if they lie so already."""
    w = Window.partitionBy("doc_id").orderBy("position", "element_id")
    return elements.select("doc_id", *columns, F.row_number().over(w).alias("nth"))


def _late_parents(elements: DataFrame) -> DataFrame:
    """(up): parents that are no open ancestor where their child stands; they are missing or out of document order."""
    kind = elements.schema["parent_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = object()
        stack: list = []
        at: dict = {}
        for batch in batches:
            late = set()
            for d, own, parent in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if d != doc:
                    doc = d
                    stack.clear()
                    at.clear()
                inner = parent is not None and parent != own
                if inner and parent not in at:
                    late.add(parent)
                keep = at[parent] + 1 if inner and parent in at else 0
                while len(stack) > keep:
                    at.pop(stack.pop(), None)
                at[own] = len(stack)
                stack.append(own)
            if late:
                yield pa.RecordBatch.from_arrays([pa.array(list(late), batch.column(2).type)], names=["up"])

    return _in_order(elements, "element_id", "parent_id").mapInArrow(walk, f"up {kind}")


def _contexts_walked(elements: DataFrame, before: int, after: int, children: int) -> DataFrame:
    """Contexts of elements in document order: a task holds the ancestors of the current row and its last neighbours only."""
    kind = elements.schema["element_id"].dataType.simpleString()
    names = ["element_id", "text", "parents", "siblings", "children"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = object()
        # an element: [id, text or None, parents, texts before, texts after, children, number of children, is it closed]
        stack: list[list] = []
        at: dict = {}
        recent: deque = deque()  # shown elements that texts after them may still join
        last: deque = deque(maxlen=before)
        out, size, own_type = [], 0, None

        def show(e: list) -> None:
            nonlocal size
            row = (e[0], e[1], e[2], e[3] + e[4], e[5])
            size += len(e[1]) + sum(len(t) for texts in row[2:] for t in texts)
            out.append(row)

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                e = stack.pop()
                at.pop(e[0], None)
                e[7] = True
                if e[1] is not None and len(e[4]) == after:
                    show(e)

        def end() -> None:
            close(0)
            for e in recent:
                show(e)
            recent.clear()
            last.clear()

        def flushed() -> pa.RecordBatch:
            nonlocal size
            texts = pa.list_(pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (own_type, pa.string(), texts, texts, texts))]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            own_type = batch.schema.field("element_id").type
            for d, own, parent, text, shown, counted in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if d != doc:
                    end()
                    doc = d
                above = None
                if parent is not None and parent != own and parent in at:
                    close(at[parent] + 1)
                    above = stack[-1]
                else:
                    close(0)
                parents = [] if above is None else above[2] if above[1] is None else [above[1], *above[2]]
                e = [own, text if shown else None, parents, list(last), [], [], 0, False]
                at[own] = len(stack)
                stack.append(e)
                up = e if parent == own else above
                if counted and up is not None:
                    up[6] += 1
                    if shown and up[6] <= children:
                        up[5].append(text)
                if shown:
                    for r in recent:
                        r[4].append(text)
                    while recent and len(recent[0][4]) == after:
                        r = recent.popleft()
                        if r[7]:
                            show(r)
                    if after:
                        recent.append(e)
                    last.append(text)
                if len(out) >= 10_000 or size >= 4_000_000:
                    yield flushed()
        end()
        if out:
            yield flushed()

    has_text = F.coalesce(F.trim("text") != "", F.lit(False))
    rows = _in_order(
        elements,
        "element_id",
        "parent_id",
        "text",
        (has_text & F.coalesce(F.col("element_type") != "root", F.lit(False))).alias("shown"),
        (has_text & F.col("parent_id").isNotNull()).alias("counted"),
    )
    return rows.mapInArrow(walk, f"element_id {kind}, text string, parents array<string>, siblings array<string>, children array<string>")


def _contexts_joined(elements: DataFrame, before: int, after: int, children: int) -> DataFrame:
    full = elements.where("element_type <> 'root' AND trim(text) <> ''").select("element_id", "doc_id", "parent_id", "position", "text")
    texts = full.select(F.col("element_id").alias("__id"), F.col("text").alias("__text"))

    def listed(ids: DataFrame, name: str) -> DataFrame:
        rows = ids.select("element_id", F.posexplode("ids").alias("nth", "__id")).join(texts, "__id")
        return rows.groupBy("element_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "__text"))), lambda x: x["__text"]).alias(name))

    up = ancestry(elements).select("element_id", F.col("ancestor_ids").alias("ids"))
    near = neighbours(elements, before, after).select("element_id", F.concat("predecessors", "successors").alias("ids"))
    down = first_children(elements, children).select("element_id", F.col("children").alias("ids"))
    out = full.select("element_id", "text")
    for ids, name in ((up, "parents"), (near, "siblings"), (down, "children")):
        out = out.join(listed(ids, name), "element_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def cross_document_context(edges: DataFrame, elements: DataFrame, top: int = 3) -> DataFrame:
    """(element_id, target_id, target_doc_id, text, similarity): the most similar elements of other documents of each element.

    edges: semantic_section rows source_id, relationship_type, target_reference, confidence.
    """
    near = edges.where("relationship_type = 'semantic_section'")
    target = elements.select(F.col("element_id").alias("target_reference"), F.col("doc_id").alias("target_doc_id"), "text")
    own = elements.select(F.col("element_id").alias("source_id"), F.col("doc_id").alias("__doc"))
    rows = near.join(target, "target_reference").join(own, "source_id").where(F.col("target_doc_id") != F.col("__doc"))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("confidence"), "target_reference"))
    best = rows.withColumn("nth", nth).where(F.col("nth") <= top)
    return best.select(F.col("source_id").alias("element_id"), F.col("target_reference").alias("target_id"), "target_doc_id", "text", F.col("confidence").alias("similarity"))


def share_ancestor(elements: DataFrame, pairs: DataFrame, level: int) -> DataFrame:
    """The pairs (a, b) of element ids whose ancestors ``level`` steps above their parents are the same element."""
    above = ancestry(elements).select("element_id", F.try_element_at("ancestor_ids", F.lit(level + 1)).alias("up"))
    x, y = (above.select(F.col("element_id").alias(end), F.col("up").alias(f"__{end}")).where("up IS NOT NULL") for end in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where("__a = __b").select("a", "b")


def runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows with a column run: 1 more whenever the value changes, in order."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))
    return rows.withColumn("__new", changed.cast("int")).withColumn(
        "run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__new")


def _joined(body: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "element_id", body.alias("body")))), lambda x: x["body"]), separator)


def full_text(elements: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a document's elements in order, parted by blank lines."""
    return elements.where("trim(text) <> ''").groupBy("doc_id").agg(_joined(F.col("text"), "\n\n").alias("text"))


# Element types whose place among others decides how they are shown.
_GROUPED = ["list", "list_item", "table", "table_row", "table_header_row", "table_cell", "table_header"]
_GROUPED_SET = frozenset(_GROUPED)


def _blocks(elements: DataFrame) -> DataFrame:
    """(doc_id, blocks): what is shown of each document, in order.

    A block is a struct (kind, level, text, cells, head, depth, joined): the cells of a table
    row are one block of kind ``cell``; depth counts the list items around a list item.
    joined: the block before belongs to the same table or list.

    One shuffle by document; a task sorts its rows and holds the blocks of one document.
    """
    kinds = {c: elements.schema[c].dataType.simpleString() for c in ("doc_id", "element_id", "parent_id")}
    own = F.col("element_id"), F.col("parent_id")
    if kinds["element_id"] != kinds["parent_id"]:
        own = tuple(c.cast("string") for c in own)
    kind = F.col("element_type")
    shown = kind.isin(_GROUPED) | (F.trim("text") != "")
    rows = elements.where(shown).select(
        "doc_id", "position", "element_id", own[0].alias("own"), own[1].alias("parent"), kind.alias("kind"), F.col("level").cast("int").alias("level"), "text"
    )
    fields = [("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.string())), ("head", pa.bool_()), ("depth", pa.int32()), ("joined", pa.bool_())]
    schema = f"doc_id {kinds['doc_id']}, blocks array<struct<kind:string,level:int,text:string,cells:array<string>,head:boolean,depth:int,joined:boolean>>"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = object()
        page = _Page()
        docs, ends, out, doc_type = [], [0], [], None

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)]
            blocks = pa.StructArray.from_arrays(columns, names=[n for n, _ in fields])
            batch = pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks)], names=["doc_id", "blocks"])
            docs.clear(), out.clear()
            ends[:] = [0]
            return batch

        def close() -> None:
            before = len(out)
            out.extend(page.blocks())
            if len(out) > before:
                docs.append(doc)
                ends.append(len(out))

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for d, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if d != doc:
                    close()
                    doc, page = d, _Page()
                    if len(out) >= 10_000:
                        yield flushed()
                page.add(*row)
        close()
        if out:
            yield flushed()

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "position", "element_id").mapInArrow(walk, schema)


class _Page:
    """Blocks of one document, whose elements come by position.

    Only elements of the grouped types have places in the tree; those above an item or a
    cell are found as ``labels`` finds them.
    """

    def __init__(self) -> None:
        self.found: list[list] = []  # position, id, kind, level, text, cells, head, own, node
        self.rows: dict[object, list] = {}
        self.holders: dict[object, object] = {}  # of list items
        self.nodes: list[list] = []  # id, the node above, items up to here, the holder of the outermost of those
        self.open: list[list] = []
        self.at: dict[object, int] = {}
        self.moved = False

    def _place(self, own: object, parent: object) -> list:
        stack, at = self.open, self.at
        root = parent is None or parent == own
        known = not root and parent in at
        for _ in range(len(stack) - (at[parent] + 1 if known else 0)):
            at.pop(stack.pop()[0], None)
        if not root and not known:
            self._push(parent)
        return self._push(own)

    def _push(self, own: object) -> list:
        node = [own, self.open[-1] if self.open else None, 0, None]
        self.at[own] = len(self.open)
        self.open.append(node)
        self.nodes.append(node)
        return node

    def add(self, position, element_id, own, parent, kind, level, text) -> None:
        node = self._place(own, parent) if kind in _GROUPED_SET else None
        if kind == "table_cell" or kind == "table_header":
            above = node[1] and node[1][1]
            table = above[0] if above else None
            row = self.rows.get(parent)
            if row is None:
                row = self.rows[parent] = [position, element_id, "cell", None, None, [], False, table, None]
                self.found.append(row)
            elif element_id is not None and (row[1] is None or element_id < row[1]):
                row[1], self.moved = element_id, True
            row[5].append(text)
            row[6] = row[6] or kind == "table_header"
            if table is not None and (row[7] is None or table < row[7]):
                row[7] = table
        elif kind == "list_item":
            self.holders[own] = parent
            if text is not None and text.strip(" "):
                self.found.append([position, element_id, "item", None, text, None, None, parent, node])
        elif text is not None and text.strip(" "):
            self.found.append([position, element_id, kind, level, text, None, None, None, None])

    def blocks(self) -> Iterator[tuple]:
        for node in self.nodes:  # those above come first
            up = node[1]
            items, holder = (up[2], up[3]) if up else (0, None)
            if node[0] in self.holders:
                node[2], node[3] = items + 1, holder if items else self.holders[node[0]]
            else:
                node[2], node[3] = items, holder
        if self.moved:
            self.found.sort(key=lambda b: (b[0] is not None, b[0], b[1] is not None, b[1]))
        last, last_own = None, None
        for _, _, kind, level, text, cells, head, own, node in self.found:
            depth = None
            if node:
                up = node[1]
                depth = up[2] if up else 0
                if depth and up[3] is not None:
                    own = up[3]
            joined = kind == last and own == last_own and kind in ("cell", "item")
            last, last_own = kind, own
            yield kind, level, text, cells, head, depth, joined


def _laid(elements: DataFrame, body: Callable[[Column, Column, Column], Column], gap: tuple[str, str], name: str) -> DataFrame:
    """(doc_id, name): the bodies of the blocks in order, each after its gap but for the first.

    body gets a block and its neighbours, which are null unless they belong to the same
    table or list; gap: inside of those, and elsewhere.
    """

    def shown(block: Column, i: Column) -> Column:
        after = F.get("blocks", i + 1)
        between = F.when(i == 0, "").when(block["joined"], gap[0]).otherwise(gap[1])
        return F.concat(between, body(block, F.when(block["joined"], F.get("blocks", i - 1)), F.when(after["joined"], after)))

    return _blocks(elements).select("doc_id", F.array_join(F.transform("blocks", shown), "").alias(name))


def as_markdown(elements: DataFrame) -> DataFrame:
    """(doc_id, markdown): headers, nested list items, code, quotes, and tables, whose first row is followed by the rule.

    Blocks are parted by a blank line, rows of a table and items of a list by a line's end.
    """

    def body(block: Column, before: Column, after: Column) -> Column:
        kind, text, cells = block["kind"], block["text"], block["cells"]
        line = F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda t: F.replace(t, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size(cells)))
        return (
            F.when(kind == "cell", F.when(before.isNull(), F.concat(line, rule)).otherwise(line))
            .when(kind == "item", F.concat(F.repeat(F.lit("  "), block["depth"]), F.lit("- "), text))
            .when(kind == "header", F.concat(F.repeat(F.lit("#"), F.coalesce(block["level"], F.lit(1))), F.lit(" "), text))
            .when(kind == "code_block", F.concat(F.lit("```\n"), text, F.lit("\n```")))
            .when(kind == "blockquote", F.concat(F.lit("> "), text))
            .otherwise(text)
        )

    return _laid(elements, body, ("\n", "\n\n"), "markdown")


def _safe(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def as_html(elements: DataFrame) -> DataFrame:
    """(doc_id, html): a tag per element; one table with head and body for the rows of a table, nested lists for nested items."""
    no = F.lit("")

    def body(block: Column, before: Column, after: Column) -> Column:
        kind, head, text = block["kind"], block["head"], block["text"]
        tag = F.when(head, "th").otherwise("td")
        cells = F.transform(block["cells"], lambda t: F.concat(F.lit("<"), tag, F.lit(">"), _safe(t), F.lit("</"), tag, F.lit(">")))
        part = F.when(head, "thead").otherwise("tbody")
        row = F.concat(
            F.when(before.isNull(), "<table>").otherwise(no),
            F.when(before.isNull() | (before["head"] != head), F.concat(F.lit("<"), part, F.lit(">"))).otherwise(no),
            F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"),
            F.when(after.isNull() | (after["head"] != head), F.concat(F.lit("</"), part, F.lit(">"))).otherwise(no),
            F.when(after.isNull(), "</table>").otherwise(no),
        )
        # an item stays open while deeper ones follow, and closes the lists that end with it
        depth = block["depth"]
        up, down = F.coalesce(before["depth"], F.lit(-1)), F.coalesce(after["depth"], F.lit(-1))
        item = F.concat(
            F.repeat(F.lit("<ul>"), F.greatest(depth - up, F.lit(0))),
            F.lit("<li>"), _safe(text),
            F.when(down > depth, no).otherwise(F.lit("</li>")),
            F.repeat(F.lit("</ul></li>"), F.greatest(depth - F.greatest(down, F.lit(0)), F.lit(0))),
            F.when(after.isNull(), "</ul>").otherwise(no),
        )
        plain = (
            F.when(kind == "header", F.concat(F.lit("h"), F.coalesce(block["level"], F.lit(1)).cast("string")))
            .when(kind == "code_block", "pre")
            .when(kind == "blockquote", "blockquote")
            .otherwise("p")
        )
        other = F.concat(F.lit("<"), plain, F.lit(">"), _safe(text), F.lit("</"), plain, F.lit(">"))
        return F.when(kind == "cell", row).when(kind == "item", item).otherwise(other)

    return _laid(elements, body, ("", "\n"), "html")


def as_office_html(elements: DataFrame) -> DataFrame:
    """(doc_id, html): page parts and notes of text documents and the slides of presentations as classed blocks.

    A slide holds what follows it up to the next one.
    """
    kind, text = F.col("element_type"), _safe(F.col("text"))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in (("page_header", "page-header"), ("page_footer", "page-footer"), ("slide_notes", "slide-notes"), ("text_box", "text-box"), ("footnote", "footnote"), ("comment", "comment"), ("chart", "chart")) for x in pair]), kind)
    tag = F.when(kind == "header", F.concat(F.lit("h"), F.coalesce("level", F.lit(3)).cast("string"))).otherwise("p")
    block = F.when(named.isNotNull(), F.concat(F.lit('<div class="'), named, F.lit('">'), text, F.lit("</div>"))).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">")))
    w = Window.partitionBy("doc_id").orderBy("position", "element_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = elements.withColumn("__slide", F.sum((kind == "slide").cast("int")).over(w))
    body = F.when(F.trim("text") != "", block)
    slides = placed.groupBy("doc_id", "__slide").agg(F.min("position").alias("position"), F.min("element_id").alias("element_id"), _joined(body, "\n").alias("inner"))
    whole = F.when(F.col("__slide") > 0, F.concat(F.lit('<div class="slide"><div class="slide-title">Slide '), F.col("__slide").cast("string"), F.lit("</div>\n"), F.col("inner"), F.lit("</div>"))).otherwise(F.col("inner"))
    return slides.where("inner <> '' OR __slide > 0").groupBy("doc_id").agg(_joined(whole, "\n").alias("html"))


def complete(documents: DataFrame, elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Each document's columns with its text, its elements in order and their outgoing edges, as arrays of structs.

    Documents without elements have empty arrays and an empty text.
    """
    own = F.struct("position", "element_id", "parent_id", "element_type", "level", "text")
    held = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("elements"))
    link = F.struct("source_id", "relationship_type", "target_reference")
    out = edges.join(elements.select(F.col("element_id").alias("source_id"), "doc_id"), "source_id")
    linked = out.groupBy("doc_id").agg(F.array_sort(F.collect_list(link)).alias("edges"))
    full = documents.join(held, "doc_id", "left").join(linked, "doc_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.filter(F.col(c), lambda _: F.lit(False)), F.from_json(F.lit("[]"), full.schema[c].dataType)).alias(c)
    body = F.array_join(F.transform(F.filter("elements", lambda e: F.trim(e["text"]) != ""), lambda e: e["text"]), "\n\n")
    rest = [c for c in documents.columns if c != "text"]
    return full.select(*rest, F.coalesce(body, F.lit("")).alias("text"), empty("elements"), empty("edges"))


def detected_format(elements: DataFrame) -> DataFrame:
    """(doc_id, format): by the element types that occur."""
    has = lambda *t: F.bool_or(F.col("element_type").isin(*t))
    return elements.groupBy("doc_id").agg(
        F.when(has("slide"), "pptx")
        .when(has("workbook", "sheet"), "xlsx")
        .when(has("json_object", "json_array"), "json")
        .when(has("xml_element"), "xml")
        .when(has("header", "list", "code_block"), "markdown")
        .otherwise("text")
        .alias("format")
    )
