"""Prefix trie of rebuilt conversations by composable monoid fingerprints.

A sequence of turns has the fingerprint (n, H) with H = sum of t_i * A^i mod p over its turns, four times
with bases and turn hashes of their own (p = 2^31 - 1). Fingerprints compose without the turns: a head
(n1, H1) followed by a suffix (n2, H2) is (n1 + n2, H1 + A^n1 * H2), and the suffix after the first h turns of
a conversation is the quotient of two of its prefixes. A rebuilt conversation (head of the base, own suffix)
is therefore never written: every prefix of it is one narrow row that composes a stored head of its base with
stored prefixes of its own and refers to one stored turn.

* Nodes are the groups of equal (depth, fingerprint). Every row carries the SHA-256 of the stored turn it
  refers to; a node whose rows refer to unlike turns is a collision, and the trie is built again with other
  bases. Equal last turns at every depth make equal sequences, as the parent's fingerprint follows from the
  node's and its last turn's.
* Every node belongs to its smallest member. What a node owes its subtree (a leaf, a child, saved bytes) is
  written on that member's row, summed towards the root along each conversation, and added up per node: no
  join of parents with children. Nodes with many members are counted under salts, and only the salts in use
  meet the rows again.
* The members that end at a node are dealt out by ranges of (node, conversation) and hashed as a stream; nodes
  that cross a range border pass on their text in chunks, which one task hashes in order.

Texts never cross the network. Null role or text counts as empty. Turns are ordered by turn number (null
first), equal numbers by the SHA-256 of role and text; repeated rows are turns of their own. Rows with a null
conversation id take no part. Extra columns are ignored. An empty table has no nodes; otherwise there is a
root, even if all rebuilt conversations are turnless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PRIME = (1 << 31) - 1
LANES = 4
SALTS = 128
CHUNK_BYTES = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_H = [f"h{k}" for k in range(LANES)]
_KEY = ["depth", "ka", "kb"]


def bases(seed: int) -> list[int]:
    """The bases A of the fingerprint's lanes."""
    return [int.from_bytes(hashlib.sha256(f"base {seed} {k}".encode()).digest()[:8], "big") % (PRIME - 2) + 2 for k in range(LANES)]


def _times(x: Column, y: Column) -> Column:
    """x * y mod p; the product of two residues fits 62 bits."""
    return (x * y) % F.lit(PRIME)


def power(base: int, exponent: Column) -> Column:
    """base^exponent mod p for an exponent in [0, 2^40), from the squares of the base."""
    squares = F.lit([pow(base, 1 << k, PRIME) for k in range(40)]).cast("array<bigint>")
    bits = F.sequence(F.lit(0), F.floor(F.log2(exponent.cast("double") + 1)).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        is_set = F.call_function("shiftright", exponent, k).bitwiseAND(F.lit(1)) == 1
        return F.when(is_set, _times(acc, F.element_at(squares, k + 1))).otherwise(acc)

    return F.aggregate(bits, F.lit(1).cast("long"), step)


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 (binary) of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def elements(digest: Column) -> list[Column]:
    """The turn's hash in every lane, 31 bits each."""
    out = []
    for k in range(LANES // 2):
        x = F.xxhash64(F.lit(k), digest)
        out += [F.pmod(x.bitwiseAND(F.lit(PRIME)), F.lit(PRIME)), F.pmod(F.shiftrightunsigned(x, 31).bitwiseAND(F.lit(PRIME)), F.lit(PRIME))]
    return out


def compose(head: tuple[Column, list[Column]], suffix: list[Column], seed: int) -> list[Column]:
    """Lanes of the head (n, H) followed by a suffix with lanes ``suffix``."""
    n, h = head
    return [(h[k] + _times(power(a, n), suffix[k])) % F.lit(PRIME) for k, a in enumerate(bases(seed))]


def quotient(whole: list[Column], skipped: Column, head: list[Column], seed: int) -> list[Column]:
    """Lanes of what follows the first ``skipped`` turns (lanes ``head``) in a sequence with lanes ``whole``."""
    return [_times(F.pmod(whole[k] - head[k], F.lit(PRIME)), power(pow(a, PRIME - 2, PRIME), skipped)) for k, a in enumerate(bases(seed))]


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """One narrow row per turn: conv_id, pos (from 1), size, the prefix's lanes, the turn's digest and bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = conversations.where("conv_id is not null") \
        .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"),
                F.octet_length(text).cast("long").alias("bytes"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = narrow.withColumn("pos", F.row_number().over(order).cast("long"))
    weighed = placed.select("*", *[_times(e, power(a, F.col("pos"))).alias(f"w{k}")
                                   for k, (a, e) in enumerate(zip(bases(seed), elements(F.col("digest")), strict=True))])
    running = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return weighed.select("conv_id", "pos", "digest", "bytes", F.count("*").over(whole).alias("size"),
                          *[(F.sum(f"w{k}").over(running) % F.lit(PRIME)).alias(_H[k]) for k in range(LANES)])


def _packed(lanes: list[Column]) -> list[Column]:
    """The four lanes as two longs."""
    return [F.shiftleft(lanes[2 * k], 31).bitwiseOR(lanes[2 * k + 1]).alias(name) for k, name in enumerate(("ka", "kb"))]


def prefixes(turns: DataFrame, base: Column, keep: Column, max_head: int, seed: int) -> DataFrame:
    """One row per prefix of every rebuilt conversation, the empty one included.

    ``base`` and ``keep`` give, from conv_id, whose head opens the rebuilt conversation and how many
    turns (at most ``max_head``) it has. Columns: conv_id, depth, ka, kb (fingerprint), digest and bytes of the last
    turn, is_end.
    """
    head = F.struct("pos", *_H, "digest", "bytes")
    heads = turns.where(F.col("pos") <= max_head).groupBy(F.col("conv_id").alias("base")) \
        .agg(F.array_sort(F.collect_list(head)).alias("heads"))
    no_heads = F.array().cast(heads.schema["heads"].dataType)
    convs = turns.withColumn("keep", keep.cast("long")).groupBy("conv_id") \
        .agg(F.max("size").alias("size"), F.max("keep").alias("keep"),
             *[F.max(F.when(F.col("pos") == F.col("keep"), F.col(h))).alias(f"own_{h}") for h in _H])
    plan = convs.withColumn("base", base).join(heads, "base", "left") \
        .withColumn("heads", F.slice(F.coalesce("heads", no_heads), F.lit(1), F.col("keep").cast("int"))) \
        .withColumn("taken", F.size("heads").cast("long")) \
        .withColumn("last", F.try_element_at("heads", F.greatest(F.col("taken"), F.lit(1)).cast("int"))) \
        .withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("keep"), F.lit(0)))
    none = F.struct(F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(h) for h in _H],
                    F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    opened = plan.select("conv_id", "length", F.explode(F.concat(F.array(none), "heads")).alias("p")) \
        .select("conv_id", F.col("p.pos").alias("depth"), *_packed([F.col(f"p.{h}") for h in _H]), "p.digest", "p.bytes", "length")
    joint = plan.where("size > keep").select(
        "conv_id", "keep", "taken", "length", *[F.coalesce(F.col(f"last.{h}"), F.lit(0)).alias(f"base_{h}") for h in _H],
        *[F.coalesce(f"own_{h}", F.lit(0)).alias(f"own_{h}") for h in _H])
    own = turns.join(joint, "conv_id").where(F.col("pos") > F.col("keep"))
    suffix = quotient([F.col(h) for h in _H], F.col("keep"), [F.col(f"own_{h}") for h in _H], seed)
    lanes = compose((F.col("taken"), [F.col(f"base_{h}") for h in _H]), suffix, seed)
    followed = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("keep")).alias("depth"), *_packed(lanes), "digest", "bytes", "length")
    return opened.unionByName(followed).withColumn("is_end", F.col("depth") == F.col("length")).drop("length")


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the prefix rows: key, conv_id (smallest member), n_convs, n_ends, bytes, the salts in use, alike."""
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int").alias("salt")
    parts = rows.groupBy(*_KEY, salt).agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.sum(F.col("is_end").cast("long")).alias("e"),
        F.max("bytes").alias("bytes"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    return parts.groupBy(*_KEY).agg(
        F.min("rep").alias("rep"), F.sum("n").alias("n_convs"), F.sum("e").alias("n_ends"), F.max("bytes").alias("bytes"),
        F.collect_list("salt").alias("salts"), (F.min("lo") == F.max("hi")).alias("alike"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    kinds = [pa.string() if n in ("sha", "chunk") else pa.int64() for n in names]
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _end_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv_id) -> per node its ids' hash; nodes at the range's borders and long ones as chunks of ids."""
    names = [*_KEY, "first", "sha", "chunk"]
    out: list[tuple] = []
    key, ids, size = None, [], 0
    open_ = True  # the node may have ids in another range or already left some in a chunk

    def close() -> None:
        text = ",".join(map(str, ids))
        out.append((*key, ids[0], None, text) if open_ else (*key, ids[0], hashlib.sha256(text.encode()).hexdigest(), None))

    for batch in batches:
        for d, a, b, c in zip(*(batch.column(n).to_pylist() for n in (*_KEY, "conv_id")), strict=True):
            if key != (d, a, b):
                if key is not None:
                    close()
                    open_ = False
                key, ids, size = (d, a, b), [], 0
            elif size >= CHUNK_BYTES:
                open_ = True
                close()
                ids, size = [], 0
            ids.append(c)
            size += 12
            if len(out) >= 256:
                yield _batch(out, names)
    if key is not None:
        open_ = True
        close()
    yield _batch(out, names)


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, first id) -> one hash per node, as a stream."""
    names = [*_KEY, "sha"]
    out: list[tuple] = []
    key, digest = None, None
    for batch in batches:
        for d, a, b, text in zip(*(batch.column(n).to_pylist() for n in (*_KEY, "chunk")), strict=True):
            if key == (d, a, b):
                digest.update(b"," + text.encode())
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = (d, a, b), hashlib.sha256(text.encode())
        yield _batch(out, names)
    if key is not None:
        out.append((*key, digest.hexdigest()))
    yield _batch(out, names)


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of every node at which a member ends."""
    ordered = rows.where("is_end").select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    key = "depth long, ka long, kb long"
    parts = materialize(ordered.mapInArrow(_end_chunks, f"{key}, first long, sha string, chunk string"), "trie-ends")
    crossing = parts.where("sha is null").drop("sha").repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return parts.where("sha is not null").select(*_KEY, F.col("sha").alias("ends_sha256")) \
        .unionByName(crossing.mapInArrow(_join_chunks, f"{key}, sha string").withColumnRenamed("sha", "ends_sha256"))


def trie(conversations: DataFrame, base: Column, keep: Column, max_head: int) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix trie.

    ``base`` and ``keep`` are columns over conv_id: each conversation is rebuilt as the first ``keep`` turns
    (0 to ``max_head``) of conversation ``base``, then its own turns after its first ``keep``. Columns: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    seed = 0
    while True:
        turns = materialize(stored_turns(conversations, seed), "trie-turns")
        rows = materialize(prefixes(turns, base, keep, max_head, seed), "trie-rows")
        found = materialize(nodes(rows), "trie-nodes")
        if found.where("not alike").isEmpty():
            break
        seed += 1
    shared = found.where("n_convs > 1").select(*_KEY, "rep", "n_convs", "n_ends", F.explode("salts").alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(shared, [*_KEY, "salt"], "left") \
        .select(*_KEY, "conv_id", "bytes", F.coalesce("rep", "conv_id").alias("rep"), F.coalesce("n_convs", F.lit(1)).alias("n"),
                F.coalesce("n_ends", F.col("is_end").cast("long")).alias("e"))
    # Along each conversation from its end to the root; the row before is the child's, the row after the parent's.
    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("rep") == F.col("conv_id")
    owed = met.select(
        *_KEY, "conv_id", "n", mine.alias("mine"), F.lead("rep").over(down).alias("parent"),
        F.coalesce(F.lag(mine.cast("long")).over(down), F.lit(0)).alias("child"),
        F.sum((mine & (F.col("e") == F.col("n"))).cast("long")).over(so_far).alias("leaves"),
        F.sum(F.when(mine, (F.col("n") - 1) * F.col("bytes")).otherwise(0)).over(so_far).alias("saved"))
    out = owed.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("mine"), F.col("parent"))).alias("parent_conv_id"), F.max("n").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return out.join(ends(rows), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
