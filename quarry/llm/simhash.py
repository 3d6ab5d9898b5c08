"""SimHash fingerprints and their self-join as a joint walk of a binary trie with itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bound_batches, materialize, null_key, packed_row, unpacked_row
from quarry.llm.components import connected_components

#: Seed of XXH64 over shingles.
SEED = 42
#: Shingles hashed and counted at a time, whatever the length of a text.
CHUNK = 8192
#: Pairs of nodes this small are compared directly instead of being split on.
LEAF = 64
#: Rows of one prefix beyond which its part of the trie is dealt out further.
HOT = 50_000
#: Equal values that are compared one by one, and neighbours in larger groups.
ALL, NEXT = 256, 32
#: Ids that may be broadcast (8 bytes each) to take rows out without a shuffle.
BROADCAST_ROWS = 1_000_000
#: Near-duplicates: words of a shingle, least similarity and tables of 32 bits.
WORDS, SIMILAR, TABLES = 5, 0.8, 24
#: Texts of so many distinct shingles or fewer meet through equal shingles, since
#: majority bits say little of them.
SHORT = 64
#: Standard deviations by which the bits of a pair may be off before its texts are not compared.
SLACK = 6


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's ``size``-word shingles, repeats included, in chunks.

    A-Z are lower-cased; words are runs of other than the six ASCII white-space
    characters. Fewer words make one shingle, none make no shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    size = min(size, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends, h = ends[size - 1 :].tolist(), xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        yield np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)], np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(text, size), np.empty(0, np.uint64)]))


def signature(text: str | None, size: int, lanes: int = 1, distinct: bool = False) -> tuple[np.ndarray, int]:
    """``lanes`` 64-bit fingerprints and the number of shingles.

    Bit j of lane 0 is 1 if bit j is set in over half of the hashes; further
    lanes do the same for re-mixed hashes. Repeats count unless ``distinct``.
    """
    counts, n = np.zeros(64 * lanes, np.int64), 0
    once = shingle_set(text, size) if distinct else None
    for h in shingle_hashes(text, size) if once is None else (once[i : i + CHUNK] for i in range(0, len(once), CHUNK)):
        n += len(h)
        wide = np.empty((len(h), lanes), np.uint64)
        wide[:, 0] = h
        for k in range(1, lanes):
            x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, k] = x ^ (x >> np.uint64(31))
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64), n


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, lanes: int = 1, distinct: bool = False, few: int = 0) -> DataFrame:
    """``_id, _n, _sig``: each row's id, number of shingles and fingerprints (longs).

    With ``few``, ``_few`` has the distinct shingles of texts of so many at
    most, a single 0 for texts without words; else it is empty.
    """
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_n", T.LongType()), T.StructField("_sig", T.ArrayType(T.LongType())), *[T.StructField("_few", T.ArrayType(T.LongType()))] * (few > 0)])

    def run(batches):
        for b in batches:
            found = [signature(t, size, lanes, distinct) for t in b["_text"]]
            out = pd.DataFrame({"_id": b["_id"], "_n": [n for _, n in found], "_sig": [s.view(np.int64) for s, _ in found]})
            if few:
                out["_few"] = [shingle_set(t, size).view(np.int64) if 0 < n <= few else np.zeros(int(n == 0), np.int64) for t, (_, n) in zip(b["_text"], found, strict=True)]
            yield out

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)


def walk(v: np.ndarray, pairs: tuple[np.ndarray, ...], top: int, budget: int, bottom: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all linked values below pairs of trie nodes.

    ``v`` holds sorted values; a node is a range of them that agrees above bit
    ``top``. ``pairs`` are the ranges (a_lo, a_hi, b_lo, b_hi) and the bits in
    which they differ so far; equal ranges pair a node with itself. All pairs go
    down together, a bit at a time: children on unlike sides cost one bit of the
    budget, and pairs beyond it are pruned. Bits under ``bottom`` are not used.
    """
    a0, a1, b0, b1, used = pairs
    for bit in range(top, bottom - 2, -1):
        live = (a1 > a0) & (b1 > b0) & (used <= budget) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 < 2))
        small = live & ((a1 - a0) * (b1 - b0) <= LEAF) if bit >= bottom else live
        if small.any():
            yield from _compare(v, a0[small], a1[small], b0[small], b1[small], budget)
        live &= ~small
        if not live.any():
            return
        a0, a1, b0, b1, used = a0[live], a1[live], b0[live], b1[live], used[live]
        ones = np.concatenate(([0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = (a0 == b0) & (a1 == b1)
        other = ~own  # a node with itself meets its two children's pair once
        a0, a1, b0, b1, used = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[other]),
                (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]),
                (bm, b1, b1, bm[other]),
                (used, used, used + 1, used[other] + 1),
            )
        )


def _compare(v, a0, a1, b0, b1, budget):
    """Checks pairs of small nodes value by value, a few million at a time.

    Large nodes only come here with all bits spent, as rows of equal values
    (several texts of one fingerprint). Up to ``ALL`` of them meet one by one;
    in larger groups each meets the ``NEXT`` following and the first ones of the
    other node, which connects what all pairs would if they are alike.
    """
    na, nb = a1 - a0, b1 - b0
    big = na * nb > LEAF
    for x0, x1, y0, y1 in zip(a0[big], a1[big], b0[big], b1[big], strict=True):
        m = int(x1 - x0)
        if (x0, x1) == (y0, y1):
            for off in range(1, m if m <= ALL else NEXT + 1):
                i = np.arange(x0, x1 - off)
                yield i, i + off
            if m > ALL:
                for lead in range(x0, x0 + NEXT):
                    i = np.arange(x0 + NEXT, x1)
                    yield np.full(len(i), lead), i
        else:
            for lead in range(y0, min(y1, y0 + (ALL if m <= ALL else NEXT))):
                yield np.arange(x0, x1), np.full(m, lead)
            for lead in range(x0, min(x1, x0 + NEXT)):
                yield np.full(int(y1 - y0), lead), np.arange(y0, y1)
    a0, na, b0, nb = a0[~big], na[~big], b0[~big], nb[~big]
    for s in range(0, len(a0), 50_000):
        x, y, m, k = a0[s : s + 50_000], b0[s : s + 50_000], na[s : s + 50_000], nb[s : s + 50_000]
        at = np.repeat(np.arange(len(x)), m * k)
        off = np.arange(len(at)) - np.repeat(np.cumsum(m * k) - m * k, m * k)
        i, j = x[at] + off // k[at], y[at] + off % k[at]
        ok = ((x[at] != y[at]) | (i < j)) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
        yield i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which of the edges make a minimum spanning forest (Boruvka)."""
    kept, label = np.zeros(len(i), bool), np.arange(n)
    order = np.lexsort((j, i, w))
    rank = np.empty(len(i), np.int64)
    rank[order] = np.arange(len(i))
    live = np.arange(len(i))
    while len(live):
        a, b = label[i[live]], label[j[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            break
        best = np.full(n, len(rank))
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        chosen = order[np.unique(best[best < len(rank)])]
        kept[chosen] = True
        # merge along the chosen edges: smallest label wins, then jump to the end
        p, q = label[i[chosen]], label[j[chosen]]
        up = np.arange(n)
        while True:
            before = up.copy()
            low = np.minimum(up[p], up[q])
            np.minimum.at(up, p, low)
            np.minimum.at(up, q, low)
            up = up[up]
            if (up == before).all():
                break
        label = up[label]
    return kept


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("distance", T.IntegerType())])


def _join_tasks(width: int, budget: int, near: int | None, similar: float):
    """Links within sorted tasks; each task's spanning forest is returned.

    ``near``: only pairs whose 128 further bits differ in so many at most count,
    and whose numbers of shingles ``_n`` allow ``similar``. What all such pairs
    connect the forest connects; for that, large groups of equal values are
    linked in a row whatever their bits.
    """

    def links(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        v = b["_v"].to_numpy().view(np.uint64)
        keys = b[["_task", "_lo", "_mask"]].to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
        lo, hi = cut[:-1], cut[1:]
        mixed = b["_mask"].to_numpy()[lo] != 0
        side = np.concatenate(([0], np.cumsum(b["_side"].to_numpy())))
        mid = np.where(mixed, hi - (side[hi] - side[lo]), hi)
        pairs = (lo, mid, np.where(mixed, mid, lo), hi, np.zeros(len(lo), np.int64))
        node, s1, s2 = (b[c].to_numpy() for c in ("_node", "_s1", "_s2"))
        names, at = np.unique(node, return_inverse=True)
        top, found = 63 - (width // (budget + 1)), []
        held = 0
        if near is not None:
            n = b["_n"].to_numpy()
            far = lambda i, j: np.bitwise_count((s1[i] ^ s1[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((s2[i] ^ s2[j]).view(np.uint64))
            first = np.concatenate(([True], v[1:] != v[:-1]))
            first[lo] = True
            run = np.cumsum(first) - 1
            large = np.bincount(run)[run] > ALL
            if large.any():
                j = np.flatnonzero(large & ~first)
                found.append((at[j - 1], at[j], far(j - 1, j)))
        for i, j in walk(v, pairs, top, budget, 64 - width):
            w = np.bitwise_count(v[i] ^ v[j]).astype(np.int64)
            if near is not None:
                w = far(i, j)
                ok = (w <= near) & (np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j]) - 1e-9)
                ok = ok | (first[i] & first[j] & (large[i] | large[j]))
                i, j, w = i[ok], j[ok], w[ok]
            found.append((at[i], at[j], w))
            held += len(i)
            if held > 2_000_000:  # only a forest of what has been found is kept
                found, held = [_thin(len(names), found)], 0
        if not found:
            return
        x, y, w = _thin(len(names), found)
        yield pd.DataFrame({"a": names[x], "b": names[y], "distance": w.astype(np.int32)})

    return _whole(links, ["_task", "_lo", "_mask"])


def _whole(links, keys: list[str]):
    """``links`` over batches of sorted rows cut so that rows of equal keys stay together."""

    def run(batches):
        tail = None
        for b in batches:
            b = b if tail is None else pd.concat([tail, b], ignore_index=True)
            last = (b[keys].to_numpy() != b[keys].to_numpy()[-1]).any(axis=1)
            done = np.flatnonzero(last)[-1] + 1 if last.any() else 0
            tail = b.iloc[done:].reset_index(drop=True)
            if done:
                yield from links(b.iloc[:done].reset_index(drop=True))
        if tail is not None and len(tail):
            yield from links(tail)

    return run


def _thin(n: int, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, w = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = forest(n, i, j, w)
    return i[keep], j[keep], w[keep]


def trie_links(rows: DataFrame, width: int, budget: int, near: int | None = None, hot: int = HOT, similar: float = SIMILAR) -> DataFrame:
    """Edges ``a, b, distance`` that connect all nodes within ``budget`` bits in a space.

    ``rows``: ``_space`` int, ``_fp`` long (``width`` bits used), ``_node`` long
    and two longs ``_s1``, ``_s2``; with ``near`` also ``_n``. Whatever two values differ by ``budget`` bits
    agree on one of budget + 1 blocks of bits, so each value goes into that many
    tries, rotated to have one block at the root with no error allowed there; a
    prefix is a task. A prefix with more than ``hot`` rows is walked down in the
    plan: its rows go to the pairs of deeper nodes within the budget.
    """
    blocks = budget + 1
    each = width // blocks
    more = [c for c in ("_n",) if c in rows.columns]
    turned = []
    for r in range(blocks):
        shift = 64 - width + r * each  # the r-th block from the top of the used bits goes to the top of the word
        body = F.shiftleft("_fp", 64 - width) if width < 64 else F.col("_fp")
        k = shift - (64 - width)
        if width < 64:
            low = F.shiftrightunsigned("_fp", width - k) if k else F.lit(0)
            rotated = (F.shiftleft("_fp", 64 - width + k)).bitwiseOR(F.shiftleft(low, 64 - width)) if k else body
        else:
            rotated = F.shiftleft("_fp", k).bitwiseOR(F.shiftrightunsigned("_fp", 64 - k)) if k else body
        turned.append(F.struct(F.lit(r).alias("r"), rotated.alias("v")))
    wide = rows.select("*", F.explode(F.array(*turned)).alias("_t"))
    block = F.shiftrightunsigned("_t.v", 64 - each)
    task = F.shiftleft((F.col("_space") * blocks + F.col("_t.r")).cast("long"), 40).bitwiseOR(block)
    wide = wide.select(task.alias("_task"), F.col("_t.v").alias("_v"), "_node", "_s1", "_s2", *more)
    counts = wide.groupBy("_task").agg(F.count("*").alias("_c"))
    crowded = materialize(counts.where(F.col("_c") > hot), "hot-prefixes")
    plain = [F.lit(0).alias("_lo"), F.lit(0).alias("_mask"), F.lit(0).alias("_side")]
    cols = ["_task", "_lo", "_mask", "_side", "_v", "_node", "_s1", "_s2", *more]
    if crowded.isEmpty():
        tasks = wide.select("*", *plain)
    else:
        deeper = F.least(F.lit(16), F.ceil(F.log2(F.col("_c") / F.lit(float(hot)))) + 1).cast("int")
        hot_rows = wide.join(crowded.withColumn("_d", deeper), "_task")
        sub = F.expr(f"cast(shiftrightunsigned(shiftleft(_v, {each}), 64 - _d) as int)")
        masks = [0, *[m for m in range(1, 1 << 16) if bin(m).count("1") <= budget]]
        hot_rows = hot_rows.withColumn("_sub", sub).withColumn("_mask", F.explode(F.filter(F.array(*[F.lit(m) for m in masks]), lambda m: m < F.expr("shiftleft(1, _d)"))))
        other = F.col("_sub").bitwiseXOR(F.col("_mask"))
        hot_rows = hot_rows.withColumn("_lo", F.least("_sub", other)).withColumn("_side", (F.col("_sub") > other).cast("int"))
        tasks = wide.join(crowded, "_task", "left_anti").select("*", *plain).select(*cols).unionByName(hot_rows.select(*cols))
    tasks = tasks.select(*cols).repartition("_task", "_lo", "_mask").sortWithinPartitions(*cols[:5], "_node")
    return tasks.mapInPandas(_join_tasks(width, budget, near, similar), EDGES)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """``id, fingerprint, component_id`` of every row.

    Fingerprints (64 bits over ``size``-word shingles) link at ``budget`` or
    fewer differing bits; a component is what links reach and is named after
    its smallest id. Copies share a fingerprint and are joined through it, never
    in pairs.

    Defined results: null, empty and blank texts have fingerprint zero, which
    links like any other; rows with a null id are kept, and a component of null
    ids alone has a null name. Repeated rows are returned as often as they
    occur. An empty table gives no rows. Other columns are ignored.
    """
    sigs = materialize(signatures(docs, id_col, text_col, size).select("_id", F.col("_sig")[0].alias("_fp")), "fingerprints")
    distinct = materialize(sigs.groupBy("_fp").agg(F.min("_id").alias("_first")), "distinct")
    rows = distinct.select(F.lit(0).alias("_space"), "_fp", F.col("_fp").alias("_node"), F.lit(0).cast("long").alias("_s1"), F.lit(0).cast("long").alias("_s2"))
    roots = connected_components(trie_links(rows, 64, budget))
    known = distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp"))
    names = known.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = known.join(names, "_root").select("_fp", "component_id")
    return sigs.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def short_links(rows: DataFrame, similar: float) -> DataFrame:
    """``a, b``: all pairs of ``_node, _n, _few`` that may share ``similar`` of their shingles.

    Of n shingles a like text has ceil(similar * n) at least, so in any common
    order of shingles the first n - ceil(similar * n) + 1 of both have one in
    common. The order is rarest first, which keeps the groups small. Texts of n and m
    shingles must share similar / (1 + similar) * (n + m); where their first common one
    has s others behind it, they share s + 1 at most, so a row knows the greatest partner
    that it can have in a group. Texts of one pattern that differ by too much in what is
    their own have no partner in the groups of the pattern's shingles, and make no pairs.
    In groups of over ``ALL`` each meets the ``NEXT`` following ones; rows with a
    ``_root`` meet all of other roots.
    """
    more = [c for c in ("_root",) if c in rows.columns]
    each = rows.select("_node", "_n", *more, F.explode("_few").alias("_key"))
    ordered = each.join(each.groupBy("_key").agg(F.count("*").alias("_c")), "_key").groupBy("_node", "_n", *more).agg(F.sort_array(F.collect_list(F.struct("_c", "_key"))).alias("_few"))
    prefix = (F.col("_n") - F.ceil(F.col("_n") * similar - 1e-9) + 1).cast("int")
    # the text without words has a shingle of its own and no size
    size = F.greatest(F.col("_n"), F.lit(1))
    most = F.floor((size - F.col("_at")) * ((1 + similar) / similar) + 1e-6) - size
    keyed = ordered.select("_node", "_n", *more, F.posexplode(F.slice("_few", F.lit(1), prefix)).alias("_at", "_f")).select(F.col("_f._key").alias("_key"), "_n", "_node", most.cast("long").alias("_most"), *more)
    keyed = keyed.where(F.col("_most") >= F.ceil(F.col("_n") * similar - 1e-9))  # others have no partner there

    def links(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, n, node, most = (b[c].to_numpy() for c in ("_key", "_n", "_node", "_most"))
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        root = b["_root"].to_numpy() if more else None
        found, held = [], 0
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo < 2 or (root is not None and (root[lo:hi] == root[lo]).all()):
                continue
            size = n[lo:hi]
            ends = lo + np.minimum(np.searchsorted(size, size / similar + 1e-9, "right"), np.searchsorted(size, most[lo:hi], "right"))
            for i, end in _partners(lo, hi, ends, root):
                if root is None and hi - lo > ALL:  # the next one whatever its size, so that groups hang together
                    j = np.arange(i + 1, max(i + 2, min(end, i + 1 + NEXT)))
                else:
                    j = i + 1 + np.flatnonzero(most[i + 1 : end] >= n[i])
                    j = j if root is None else j[root[j] != root[i]]
                if not len(j):
                    continue
                found.append((np.full(len(j), node[i]), node[j]))
                held += len(j)
                if held > 500_000:
                    yield _pairs(found)
                    found, held = [], 0
        if held:
            yield _pairs(found)

    return keyed.repartition("_key").sortWithinPartitions("_key", "_n", "_node").mapInPandas(_whole(links, ["_key"]), "a long, b long")


def _partners(lo: int, hi: int, ends: np.ndarray, root: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """The rows of a group that have any partner after them, with the end of those."""
    if root is None:
        yield from zip(range(lo, hi - 1), ends.tolist(), strict=False)
        return
    # where the next row of another root is, so that rows with none in reach cost nothing
    change = np.flatnonzero(root[lo : hi - 1] != root[lo + 1 : hi]) + 1
    other = np.full(hi - lo, hi)
    if len(change):
        at = np.searchsorted(change, np.arange(hi - lo), "right")
        known = at < len(change)
        other[known] = lo + change[at[known]]
    for k in np.flatnonzero(other < ends).tolist():
        yield lo + k, int(ends[k])


def _pairs(found: list) -> pd.DataFrame:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def near_duplicate_links(texts: DataFrame, words: int = WORDS, similar: float = SIMILAR, tables: int = TABLES) -> DataFrame:
    """Edges ``a, b`` that connect alike texts; ``texts``: ``_node`` (XXH64 of the text), ``_text``.

    Texts of up to ``SHORT`` distinct shingles meet all they may be like through
    equal shingles. For longer ones, at a similarity of 0.8 one fingerprint of
    64 bits differs in ten bits or so, too many for a trie to prune by. So a
    text gets ``tables`` fingerprints of 32 bits from re-mixed hashes of its
    distinct shingles, of which one at least differs by 2 bits or fewer (95 % of
    pairs at 0.8, 99.9 % at 0.9). Pairs whose further 128 bits are not ``SLACK``
    deviations off are kept as each task's minimum spanning forest, so closest
    texts link first and a large group gives as many edges as it has members. Of
    every such edge the two texts themselves decide. A forest that lost edges so
    may have stood for pairs that are alike, hence a second round: texts of the
    components that came apart, long ones too, meet those of other components through
    equal shingles (``short_links``), so no pair that is alike is left out. Texts of one
    pattern that are not alike make no pairs there, however many they are.
    """
    lanes, few = tables // 2 + 2, int(SHORT / similar)
    sigs = materialize(signatures(texts, "_node", "_text", words, lanes, True, few), "sketches").withColumnRenamed("_id", "_node")
    distinct = materialize(sigs.groupBy("_node").agg(F.first("_n").alias("_n"), F.first("_sig").alias("_sig"), F.first("_few").alias("_few")), "distinct")
    angle = np.arccos(2 * similar / (1 + similar)) / np.pi
    near = int(128 * angle + SLACK * np.sqrt(128 * angle * (1 - angle)))
    low = F.expr(f"explode(transform(sequence(0, {tables - 1}), i -> named_struct('s', i, 'f', shiftrightunsigned(shiftleft(_sig[cast(i / 2 as int)], 32 * (i % 2)), 32))))")

    rows = distinct.where(F.col("_n") > SHORT).select("_node", "_n", low.alias("_e"), F.col("_sig")[lanes - 2].alias("_s1"), F.col("_sig")[lanes - 1].alias("_s2"))
    rows = rows.select(F.col("_e.s").alias("_space"), F.col("_e.f").alias("_fp"), "_node", "_s1", "_s2", "_n")
    linked = trie_links(rows, 32, 2, near, similar=similar).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = linked.union(short_links(distinct.where(F.size("_few") > 0).select("_node", "_n", "_few"), similar)).distinct()
    judged = judge(texts, materialize(met, "candidates"), words, similar)
    alike = judged.where("alike").select("a", "b")
    roots = materialize(connected_components(alike), "roots")
    of = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    apart = of(of(judged.where("not alike").select("a", "b"), "a"), "b").where("ra <> rb").select(F.explode(F.array("ra", "rb")).alias("_root")).distinct()
    again = of(distinct.select("_node"), "_node").withColumnRenamed("r_node", "_root").join(materialize(apart, "apart"), "_root", "left_semi")
    again = materialize(again.select("_node", "_root"), "again")
    if again.isEmpty():
        return alike
    again = materialize(whole_sets(texts.join(again, "_node").groupBy("_node").agg(F.first("_text").alias("_text"), F.first("_root").alias("_root")), words), "whole-sets")
    edges = short_links(again, similar).distinct().join(judged.select("a", "b"), ["a", "b"], "left_anti")
    edges = materialize(edges, "further-candidates")
    return alike.unionByName(judge(texts, edges, words, similar).where("alike").select("a", "b"))


def whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """``_node, _root, _n, _few``: all distinct shingles of each text, whatever their number; a single 0 without words."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b["_text"]]
            yield pd.DataFrame({"_node": b["_node"], "_root": b["_root"], "_n": [len(x) for x in sets], "_few": [x.view(np.int64) if len(x) else np.zeros(1, np.int64) for x in sets]})

    return texts.select("_node", "_root", "_text").mapInPandas(run, "_node long, _root long, _n long, _few array<long>")


def judge(texts: DataFrame, edges: DataFrame, words: int, similar: float) -> DataFrame:
    """``a, b, alike``: whether the texts of each edge share ``similar`` of their distinct shingles."""
    nodes = edges.select(F.col("a").alias("_node")).union(edges.select("b")).distinct()
    few = nodes.count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(nodes) if few else nodes, "_node", "left_semi").groupBy("_node").agg(F.first("_text").alias("_text"))
    wanted = materialize(wanted, "edge-texts")
    pairs = edges.join(wanted.select(F.col("_node").alias("a"), F.col("_text").alias("ta")), "a").join(wanted.select(F.col("_node").alias("b"), F.col("_text").alias("tb")), "b")

    def compare(batches):
        for b in batches:
            known: dict[int, np.ndarray] = {}  # a text stands in several edges
            alike = []
            for a, x, c, y in zip(b["a"], b["ta"], b["b"], b["tb"], strict=True):
                p, q = (known[k] if k in known else known.setdefault(k, shingle_set(t, words)) for k, t in ((a, x), (c, y)))
                both = len(np.intersect1d(p, q, assume_unique=True))
                alike.append(both >= similar * (len(p) + len(q) - both))
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "alike": alike}).astype({"alike": bool})

    return materialize(pairs.mapInPandas(compare, "a long, b long, alike boolean"), "judged")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id.

    Groups are the components of ``near_duplicate_links`` over distinct texts;
    copies belong to their text. Texts without words (null, empty, blank) are alike.
    Null ids come last. Rows are told apart by id and text, never by their place in
    the input, so a task that is run again takes the same ones; of rows with the
    same id and text one stays, whichever. All columns are kept as they are,
    whatever their names; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    roots = connected_components(near_duplicate_links(docs.select(F.xxhash64(text).alias("_node"), text.alias("_text")), words, similar))
    rows = materialize(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_node")).groupBy("_id", "_node").agg(F.count("*").alias("_c")), "members")
    member = rows.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_group", F.coalesce("root", "_node"))
    first = F.struct(F.col("_id").isNull().alias("x"), "_id", "_node", "_c")
    kept = materialize(member.groupBy("_group").agg(F.min(first).alias("k")).select(null_key(F.col("k._id")).alias("_quarry_id"), F.col("k._node").alias("_quarry_node"), F.col("k._c").alias("_c")), "kept")
    keys = ["_quarry_id", "_quarry_node"]
    gone = materialize(rows.select(null_key(F.col("_id")).alias("_quarry_id"), F.col("_node").alias("_quarry_node")).join(kept, keys, "left_anti"), "gone")
    keyed = docs.select(packed_row(docs), null_key(F.col(id_col)).alias("_quarry_id"), F.xxhash64(text).alias("_quarry_node"))
    stays = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, keys, "left_anti")
    again = kept.where("_c > 1").select(*keys)
    if (n := again.count()):
        twice = F.broadcast(again) if n <= BROADCAST_ROWS else again
        stays = stays.join(twice, keys, "left_anti").unionByName(stays.join(twice, keys, "left_semi").dropDuplicates(keys))
    return unpacked_row(stays, docs.columns)
