"""Exact duplicates by owners in Patricia tries.

Texts are equal when their UTF-8 bytes are equal after lower-casing A-Z only.  The whole byte strings are inserted into compressed
radix tries; a terminal node stores the owner of its string, the number of its rows and the other terminals it stands for:

1. Every scan task keeps a trie of its own texts, so the copies of one text leave a task as one terminal, however many they are.
   Each row is written with the number of its terminal.
2. Terminals are dealt by (length, hash of the content) and meet in one trie a partition; equal strings reach the same node.
   The node's owner goes back to all terminals that reached it.
3. Rows get the owner of their terminal by a join on the terminal's number; a group of copies of any size is spread over its tasks' terminals.

Both kinds of tries are bounded in bytes.  A trie of the scan that is full hands out its largest subtrees as terminals and drops them.
A trie of the second step that is full gives whole subtrees back unanswered; they, and all later strings below them, are dealt
again in the next round over more partitions and with twice the bound, so that the rounds end.

The row that stays is the one with the largest key (``keep="smallest"``: the smallest); rows without a key come after all others.  Of
rows with equal keys and equal texts one stays.  Null counts as an empty text; all empty texts are one group.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stage, tasks_for, to_batch, unstage

BOUND = 192 << 20  # bytes of strings and nodes in one trie
NODE = 400  # bytes that a node takes beside its string
PART = 64 << 20  # bytes of strings that are dealt to one partition
OUT = 4 << 20  # bytes of strings in one batch of output
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Node:
    """An edge's label ``data[start:end]`` and what hangs below it; ``value`` is set where a string ends."""

    __slots__ = ("data", "start", "end", "below", "value")

    def __init__(self, data: bytes, start: int, end: int):
        self.data, self.start, self.end, self.below, self.value = data, start, end, {}, None


def common_length(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """How many bytes from a[i] and b[j] on agree, at most ``most``."""
    if a[i : i + most] == b[j : j + most]:
        return most
    low, high = 0, most  # agree up to low, differ before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A compressed radix trie; ``size`` estimates its bytes."""

    def __init__(self):
        self.root, self.size = Node(b"", 0, 0), 0

    def insert(self, s: bytes, new: Callable[[bytes], object]):
        """The value at the end of ``s``; ``new(s)`` where the string is not there yet."""
        node, at, n = self.root, 0, len(s)
        while at < n:
            child = node.below.get(s[at])
            if child is None:
                child = node.below[s[at]] = Node(s, at, n)
                self.size += n - at + NODE
                node = child
                break
            edge = child.end - child.start
            same = common_length(child.data, child.start, s, at, min(edge, n - at))
            if same < edge:  # the string leaves the edge, or ends on it
                fork = node.below[s[at]] = Node(child.data, child.start, child.start + same)
                child.start += same
                fork.below[child.data[child.start]] = child
                self.size += NODE
                child = fork
            node, at = child, at + same
        if node.value is None:
            node.value = new(s)
        return node.value

    def parts(self) -> list[tuple[int, int]]:
        """(bytes, first byte) of the subtrees below the root, the largest first."""
        return sorted(((sum(x.end - x.start + NODE for x in walk(child)), b) for b, child in self.root.below.items()), reverse=True)

    def take(self, first: int) -> list:
        """Drops the subtree of a first byte; its values."""
        child = self.root.below.pop(first)
        nodes = list(walk(child))
        self.size -= sum(x.end - x.start + NODE for x in nodes)
        return [x.value for x in nodes if x.value is not None]

    def values(self) -> Iterator:
        return (x.value for x in walk(self.root) if x.value is not None)


def walk(node: Node) -> Iterator[Node]:
    open_ = [node]
    while open_:
        node = open_.pop()
        yield node
        open_.extend(node.below.values())


def better(a: tuple, b: tuple, largest: bool) -> bool:
    """Whether owner ``a`` (key, row) goes before ``b``; rows without a key come last."""
    if (a[0] is None) != (b[0] is None):
        return b[0] is None
    return a > b if largest and a[0] is not None else a < b


def scanned(docs: DataFrame, key: str, text: str, largest: bool, bound: int) -> DataFrame:
    """Staged rows of two kinds: (node, key, row) of every row, and (node, key, row of the owner, body, n_bytes, content, copies, sha) of every terminal."""
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"node long, key {kind}, row long, body binary, n_bytes long, content long, copies long, sha string"
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("body"))
    schema = arrow_schema(slim, ddl)

    def terminals(values: Iterator) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for node, owner, copies, body in values:
            digest = hashlib.sha256(body).digest()
            out.append((node, owner[0], owner[1], body, len(body), int.from_bytes(digest[:8], "little", signed=True), copies, digest.hex()))
            size += len(body) + 100
            if size > OUT:
                yield to_batch(out, schema)
                out, size = [], 0
        if out:
            yield to_batch(out, schema)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        trie, row = Trie(), number
        for batch in batches:
            members = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                number += 1
                row += 1
                value = trie.insert(body.as_py().lower(), lambda s, node=number: [node, None, 0, s])
                value[2] += 1
                if value[1] is None or better((k, row), value[1], largest):
                    value[1] = (k, row)
                members.append((value[0], k, row, None, None, None, None, None))
                if trie.size > bound:
                    for size, first in trie.parts():
                        yield from terminals(trie.take(first))
                        if trie.size <= bound // 2:
                            break
            yield to_batch(members, schema)
        yield from terminals(trie.values())

    return stage(slim.mapInArrow(run, ddl), "trie-rows")


def met(dealt: DataFrame, kind: str, largest: bool, bound: int) -> DataFrame:
    """(node, owner, owner_row, group_size, sha) of every terminal; of those in a subtree that was given back, the terminal itself with its body."""
    ddl = f"node long, owner {kind}, owner_row long, group_size long, sha string, body binary, n_bytes long, content long"
    schema = arrow_schema(dealt, ddl)

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r in rows:
            out.append(r)
            size += 100 + (len(r[5]) if r[5] else 0)
            if size > OUT:
                yield to_batch(out, schema)
                out, size = [], 0
        if out:
            yield to_batch(out, schema)

    def unanswered(values: list) -> Iterator[tuple]:
        for sha, n, content, body, terminals, _ in values:
            for node, k, row, copies in terminals:
                yield node, k, row, copies, sha, body, n, content

    def run(batches):
        trie, given = Trie(), set()
        for batch in batches:
            node, k, row, copies, sha, n, content = (batch.column(c).to_pylist() for c in ("node", "key", "row", "copies", "sha", "n_bytes", "content"))
            back = []
            for i, body in enumerate(batch.column("body")):
                body = body.as_py()
                if body and body[0] in given:
                    back.append((node[i], k[i], row[i], copies[i], sha[i], body, n[i], content[i]))
                    continue
                value = trie.insert(body, lambda s, i=i: [sha[i], n[i], content[i], s, [], None])  # noqa: B023
                value[4].append((node[i], k[i], row[i], copies[i]))
                if value[5] is None or better((k[i], row[i]), value[5], largest):
                    value[5] = (k[i], row[i])
            if trie.size > bound:
                for _, first in trie.parts():
                    given.add(first)
                    yield from batched(unanswered(trie.take(first)))
                    if trie.size <= bound // 2:
                        break
            yield from batched(iter(back))

        def answered() -> Iterator[tuple]:
            for sha, _, _, _, terminals, owner in trie.values():
                size = sum(t[3] for t in terminals)
                for t in terminals:
                    yield t[0], owner[0], owner[1], size, sha, None, None, None

        yield from batched(answered())

    return dealt.mapInArrow(run, ddl)


def owners(docs: DataFrame, key: str, text: str, keep: str, bound: int, part: int) -> DataFrame:
    """(key, row, owner, owner_row, group_size, sha) of every row."""
    assert keep in ("largest", "smallest")
    largest, kind = keep == "largest", docs.schema[key].dataType.simpleString()
    rows = scanned(docs, key, text, largest, bound)
    terminals = rows.filter("sha is not null").select("node", "key", "row", "copies", "sha", "body", "n_bytes", "content")
    answers, open_ = [], terminals
    while True:
        size = open_.agg(F.sum("n_bytes")).first()[0] or 0
        parts = max(tasks_for(docs), -(-size // part))
        out = stage(met(open_.repartition(parts, "n_bytes", "content"), kind, largest, bound), "trie-owners")
        answers.append(out.filter("content is null").select("node", "owner", "owner_row", "group_size", "sha"))
        open_ = out.filter("content is not null").select("node", F.col("owner").alias("key"), F.col("owner_row").alias("row"), F.col("group_size").alias("copies"), "sha", "body", "n_bytes", "content")
        if open_.isEmpty():
            break
        bound, part = 2 * bound, max(1, part // 2)
    known = answers[0]
    for more in answers[1:]:
        known = known.union(more)
    return rows.filter("sha is null").select("node", "key", "row").join(known, "node")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", bound: int = BOUND, part: int = PART) -> DataFrame:
    """One row for each row: key, keep_id (key of the row that stays), group_size, kept, text_sha256 (of the lower-cased text)."""
    out = owners(docs, key, text, keep, bound, part)
    return out.select(F.col("key").alias(key), F.col("owner").alias("keep_id"), "group_size", (F.col("row") == F.col("owner_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", bound: int = BOUND, part: int = PART) -> DataFrame:
    """The rows that stay, with all their columns.  Rows equal in key and text are told apart by nothing: one of them stays."""
    kept = owners(docs, key, text, keep, bound, part).filter("row = owner_row")
    mark = uuid.uuid4().hex
    k, none, h = f"_k{mark}", f"_n{mark}", f"_h{mark}"
    value = F.col(f"`{key}`")
    plain = F.sha2(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER), 256)
    hashed = docs.withColumns({k: F.coalesce(value.cast("string"), F.lit("")), none: value.isNull(), h: plain})
    wanted = kept.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias(k), F.col("key").isNull().alias(none), F.col("sha").alias(h))
    return hashed.join(wanted, [k, none, h], "left_semi").dropDuplicates([k, none, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
