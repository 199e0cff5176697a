"""Trie of the prefixes of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is the head of a base conversation and the rest of its
own turns. Its texts are never put together: turns are sorted once, and each
has the fingerprint of its conversation up to it, a polynomial in the hashes of
the turns (modulo three primes). Fingerprints form a monoid: of (n, x) and
(m, y) the product is (n + m, x + r^n y). So those of a conversation that is
spread over many ranges of the sort are composed from one product a range, and
those of rebuilt prefixes from the base's head and a shifted difference of the
own ones.

Prefixes of one depth and fingerprint are a node. Fingerprints only propose:
every member must have the same parent's fingerprint and the same last turn,
which, from the root down, proves the prefixes equal; that turns of one hash
are equal is proved by comparing the stored turns in full. Should either fail,
all starts anew with other bases.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docverify.plans.storage import written

#: Below 2^31, so that a product fits a long.
PRIMES = (2147483647, 2147483629, 2147483587)
#: Depths of a conversation that are summed in one window.
STRIDE = 4096
#: Ids in a piece of a list that is digested.
PIECE = 8192
ATTEMPTS = 8

KEY = ["depth", "f0", "f1", "f2"]
PARENT = ["p0", "p1", "p2"]
_DIGITS, _BITS = 6, 6


def _power(n: Column, base: int, prime: int) -> Column:
    """base ** n modulo prime for n from 0 to 2^36, one table of 64 powers a digit of n."""
    out = F.lit(1).cast("long")
    for digit in range(_DIGITS):
        table = F.lit([pow(base, k << (_BITS * digit), prime) for k in range(1 << _BITS)]).cast("array<bigint>")
        place = F.shiftright(n, _BITS * digit).bitwiseAND((1 << _BITS) - 1).cast("int")
        out = out * F.get(table, place) % prime
    return out


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, at, turn_id, chars) of turns in their order, dealt in ranges; at grows within a part."""
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # a serial number parts rows that repeat in full, so that they too spread over ranges
    keyed = turns.select("conv_id", "turn", digest.alias("digest"), "serial", "turn_id", F.char_length("text").alias("chars"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "serial"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), "turn_id", "chars").select(
        "conv_id", F.shiftright("at", 33).alias("part"), "at", "turn_id", "chars"
    )


def _prefixes(ordered: DataFrame, bases: list[int]) -> DataFrame:
    """(conv_id, place, turn_id, chars, s0-s2): each turn's place from 1 and its conversation's fingerprint up to it."""
    within = Window.partitionBy("conv_id", "part").orderBy("at")
    local = ordered.withColumn("n", F.row_number().over(within).cast("long"))
    for k, (base, prime) in enumerate(zip(bases, PRIMES, strict=True)):
        term = F.pmod("turn_id", F.lit(prime - 1)) + 1
        local = local.withColumn(f"s{k}", F.sum(term * _power(F.col("n"), base, prime) % prime).over(within) % prime)
    local = written(local, "trie-local")
    # one product a part of a conversation, composed in the order of parts
    whole = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("n", "s0", "s1", "s2"), "n").alias("w")).select("conv_id", "part", "w.*")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, (base, prime) in enumerate(zip(bases, PRIMES, strict=True)):
        shifted = F.col(f"s{k}") * _power(F.col("n0"), base, prime) % prime
        carried = carried.withColumn(f"c{k}", F.coalesce(F.sum(shifted).over(before) % prime, F.lit(0)))
    carried = carried.select("conv_id", "part", "n0", "c0", "c1", "c2")
    joined = local.join(carried, ["conv_id", "part"])
    return joined.select(
        "conv_id", (F.col("n") + F.col("n0")).alias("place"), "turn_id", "chars",
        *[
            ((F.col(f"c{k}") + F.col(f"s{k}") * _power(F.col("n0"), base, prime) % prime) % prime).cast("int").alias(f"s{k}")
            for k, (base, prime) in enumerate(zip(bases, PRIMES, strict=True))
        ],
    )


def _plans(prefixes: DataFrame, base: Column, head: Column) -> DataFrame:
    """A row a conversation: base_id, cut (own turns replaced), head (turns of the base), depth, and the sums at both."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    plans = sizes.select("conv_id", "n_own", base.alias("base_id"), head.cast("long").alias("cut"))
    plans = plans.join(sizes.select(F.col("conv_id").alias("base_id"), F.col("n_own").alias("n_base")), "base_id", "left")
    plans = plans.withColumn("head", F.least("cut", F.coalesce("n_base", F.lit(0))))
    at = prefixes.select("conv_id", "place", "s0", "s1", "s2")
    heads = at.select(F.col("conv_id").alias("base_id"), F.col("place").alias("head"), *[F.col(f"s{k}").alias(f"h{k}") for k in range(3)])
    cuts = at.select("conv_id", F.col("place").alias("cut"), *[F.col(f"s{k}").alias(f"o{k}") for k in range(3)])
    full = plans.join(heads, ["base_id", "head"], "left").join(cuts, ["conv_id", "cut"], "left")
    zero = {f"{x}{k}": F.coalesce(f"{x}{k}", F.lit(0)) for x in "ho" for k in range(3)}
    return full.withColumns(zero).withColumn("length", F.col("head") + F.greatest(F.col("n_own") - F.col("cut"), F.lit(0)))


def _entries(prefixes: DataFrame, plans: DataFrame, bases: list[int]) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included."""
    terms = [
        lambda n, k=k, b=b, p=p: (F.pmod("turn_id", F.lit(p - 1)) + 1) * _power(n, b, p) % p
        for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True))
    ]
    common = ["conv_id", "depth", "f0", "f1", "f2", "p0", "p1", "p2", "turn_id", "chars", "turn_conv", "turn_place", "is_end"]
    own = prefixes.join(plans, "conv_id").where("place > cut").withColumn("depth", F.col("place") - F.col("cut") + F.col("head"))
    for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)):
        shift = _power(F.col("cut") - F.col("head"), pow(b, -1, p), p)
        f = (F.col(f"h{k}") + F.pmod(F.col(f"s{k}") - F.col(f"o{k}"), F.lit(p)) * shift % p) % p
        own = own.withColumn(f"f{k}", f).withColumn(f"p{k}", F.pmod(F.col(f"f{k}") - terms[k](F.col("depth")), F.lit(p)))
    own = own.withColumns({"turn_conv": F.col("conv_id"), "turn_place": F.col("place"), "is_end": F.col("depth") == F.col("length")})
    to = plans.where("head > 0").select("base_id", F.col("conv_id").alias("member"), "head", "length")
    heads = prefixes.join(to, prefixes.conv_id == to.base_id).where("place <= head").withColumn("depth", F.col("place"))
    for k, (_, p) in enumerate(zip(bases, PRIMES, strict=True)):
        heads = heads.withColumn(f"f{k}", F.col(f"s{k}")).withColumn(f"p{k}", F.pmod(F.col(f"s{k}") - terms[k](F.col("place")), F.lit(p)))
    heads = heads.withColumns(
        {"turn_conv": F.col("base_id"), "turn_place": F.col("place"), "is_end": F.col("depth") == F.col("length"), "conv_id": F.col("member")}
    )
    none = F.lit(0).cast("long")
    roots = plans.select(
        "conv_id", none.alias("depth"), *[none.alias(x) for x in common[2:9]], F.lit(0).alias("chars"), F.lit(None).cast("long").alias("turn_conv"),
        F.lit(None).cast("long").alias("turn_place"), (F.col("length") == 0).alias("is_end"),
    )
    narrow = {x: F.col(x).cast("int") for x in common[2:8]}
    return roots.withColumns(narrow).union(own.select(common).withColumns(narrow)).union(heads.select(common).withColumns(narrow))


def _nodes(entries: DataFrame) -> DataFrame:
    last = F.struct(*PARENT, "turn_id")
    return entries.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", "turn_conv", "turn_place")).alias("first"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.min(last).alias("least"), F.max(last).alias("most"),
    ).select(
        *KEY, "first.*", "n_convs", "least.*", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("least") == F.col("most")).alias("proved"),
    )


def _chains(nodes: DataFrame) -> DataFrame:
    """(KEY, tail, total): of the nodes that a conversation is the smallest member of, which lie below each other:
    the savings from each on down, and of all."""
    blocked = nodes.select(*KEY, "conv_id", "saved", F.floor(F.col("depth") / STRIDE).alias("block"))
    sums = blocked.groupBy("conv_id", "block").agg(F.sum("saved").alias("sum"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = sums.select(
        "conv_id", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("below"), F.sum("sum").over(Window.partitionBy("conv_id")).alias("total")
    )
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    local = blocked.withColumn("local", F.sum("saved").over(down))
    return local.join(below, ["conv_id", "block"]).select(*KEY, "conv_id", (F.col("local") + F.col("below")).alias("tail"), "total")


def _end_digests(entries: DataFrame) -> DataFrame:
    """(KEY, ends_sha256): ids are sorted in ranges, joined in pieces, and pieces digested one after the other."""
    key_kinds = "depth long, f0 int, f1 int, f2 int"
    order = [*KEY, "conv_id"]
    ends = entries.where("is_end").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    piece_schema = pa.schema([("depth", pa.int64()), ("f0", pa.int32()), ("f1", pa.int32()), ("f2", pa.int32()), ("first", pa.int64()), ("ids", pa.string())])

    def pieces(batches):
        key, ids, first = None, [], None
        for batch in batches:
            out = []
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (now != key or len(ids) == PIECE):
                    out.append((*key, first, ",".join(ids)))
                    ids = []
                if not ids:
                    key, first = now, conv
                ids.append(str(conv))
            yield pa.RecordBatch.from_pylist([dict(zip(piece_schema.names, x, strict=True)) for x in out], piece_schema)
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(piece_schema.names, (*key, first, ",".join(ids)), strict=True))], piece_schema)

    dealt = ends.mapInArrow(pieces, f"{key_kinds}, first long, ids string")
    digest_schema = pa.schema([*piece_schema][:4] + [pa.field("ends_sha256", pa.string())])

    def digests(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(digest_schema.names, x, strict=True)) for x in out], digest_schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(digest_schema.names, (*key, sha.hexdigest()), strict=True))], digest_schema)

    sorted_pieces = dealt.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids")
    return sorted_pieces.mapInArrow(digests, f"{key_kinds}, ends_sha256 string")


def rule_base(conv: Column) -> Column:
    return conv - conv % 100


def rule_head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 6


def prefix_trie(
    turns: DataFrame, base: Column | None = None, head: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv, turn_place.

    base and head are expressions on conv_id: the conversation whose first
    `head` turns stand for the own first `head` turns (all, if it has fewer;
    none, if it is absent); without them conversations are as they are. A node
    is a distinct sequence of the first `depth` rebuilt turns (role, text), its
    conv_id the smallest member, parent_conv_id that of its parent (null for
    the root), saved_tokens the sum, over its subtree, of (n_convs - 1) times
    the code points of a node's last text. turn_conv and turn_place name the
    stored turn that ends it (place from 1), so that texts can be fetched.

    Turns are ordered by their number, null first; rows of one number by the
    SHA-256 of role and text, and rows that repeat in full all count. A null
    role or text is empty. Rows without a conversation are left out. Other
    columns are ignored. An empty table gives no rows.
    """
    source = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("serial"),
    ).where("conv_id is not null")
    base = F.col("conv_id") if base is None else base
    head = F.lit(0) if head is None else head
    for seed in range(ATTEMPTS):
        hashed = source.withColumn("turn_id", F.xxhash64(F.lit(seed), "role", "text"))
        pair = F.struct("role", "text")
        if hashed.groupBy("turn_id").agg((F.min(pair) < F.max(pair)).alias("odd")).where("odd").take(1):
            continue
        deal = random.Random(seed)
        bases = [deal.randrange(1 << 20, p - 1) for p in PRIMES]
        prefixes = written(_prefixes(written(_ordered(hashed), "trie-turns"), bases), "trie-prefixes")
        plans = written(_plans(prefixes, base, head), "trie-plans")
        entries = written(_entries(prefixes, plans, bases), "trie-entries")
        nodes = written(_nodes(entries), "trie-nodes")
        if not nodes.where("not proved").take(1):
            break
    else:
        raise RuntimeError(f"fingerprints still collide after {ATTEMPTS} attempts")

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(f"f{k}") for k in range(3)]).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    kids = written(kids, "trie-kids")
    chains = written(_chains(nodes), "trie-chains")
    # what a member brings to each node above: its nodes' savings, and its leaf
    leaves = nodes.join(kids, KEY, "left_anti").select("conv_id", F.lit(0).cast("long").alias("total"), F.lit(1).alias("leaf"))
    totals = chains.select("conv_id", "total", F.lit(0).alias("leaf")).distinct()
    brings = written(totals.union(leaves).groupBy("conv_id").agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf")), "trie-brings")
    gathered = entries.select("conv_id", *KEY).join(brings, "conv_id").groupBy(*KEY).agg(F.sum("total").alias("brought"), F.sum("leaf").alias("n_leaves"))
    zero, text = F.lit(0).cast("long"), F.lit(None).cast("string")
    facts = (
        gathered.select(*KEY, "brought", "n_leaves", zero.alias("n_children"), text.alias("ends"))
        .union(kids.select(*KEY, zero, zero, "n_children", text))
        .union(_end_digests(entries).select(*KEY, zero, zero, zero, "ends_sha256"))
        .groupBy(*KEY)
        .agg(F.sum("brought").alias("brought"), F.sum("n_leaves").alias("n_leaves"), F.sum("n_children").alias("n_children"), F.max("ends").alias("ends"))
    )
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"f{k}").alias(f"p{k}") for k in range(3)], F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(facts, KEY).join(chains.drop("conv_id"), KEY).join(above, ["depth", *PARENT], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("brought") - F.col("total") + F.col("tail")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "turn_conv", "turn_place",
    )


ORACLE = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
source AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS turns
  FROM source GROUP BY conv_id),
cut AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 6 AS h FROM own, crc),
rebuilt AS (SELECT c.conv_id, coalesce(b.turns[:c.h], []) || c.turns[c.h + 1:] AS turns FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
entry AS (
  SELECT conv_id, d, d = len(turns) AS is_end, turns[d]['text'] AS last,
    list_transform(turns[:d], lambda x: concat(length(x['role']), ':', x['role'], length(x['text']), ':', x['text'])) AS path
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT path, any_value(d) AS d, min(conv_id) AS c, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(last)), 0) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends FROM entry GROUP BY path),
kid AS (SELECT path[:d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT e.path, sum(s.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM node s LEFT JOIN kid k ON k.path = s.path JOIN entry e ON e.conv_id = s.c AND e.d <= s.d GROUP BY e.path)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n_convs, coalesce(kid.n, 0) AS n_children, below.leaves AS n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below USING (path) LEFT JOIN kid USING (path) LEFT JOIN node up ON node.d > 0 AND up.path = node.path[:node.d - 1]
"""
