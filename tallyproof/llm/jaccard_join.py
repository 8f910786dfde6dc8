"""N-gram Jaccard join and its components.

Method: a document is the set of its word shingles. The universe of shingles is hashed into segments, as many as the
size band needs: sets whose symmetric difference is at most H leave some segment equal (pigeonhole), if there are more
than H segments. Small sets use fewer, fuller segments, indexed with their one-deletion neighbourhoods, which find a
segment that differs by one shingle. Which of the two a band uses is decided by cost: signatures, plus segments too
thin to tell documents apart. Documents that share a signature are candidates, and all candidates are verified on their
whole sets.

Segments that many documents share are skipped: a pair found through them only consists of two documents that have too
few other segments, and these documents are joined by a prefix filter on their rarest shingles. The members of a group
meet its leader first; of what is still apart then, members outside the group's largest component meet the others, so
that a large group of copies and few strangers makes few pairs. Equal sets are one node throughout. Links inside a component that is known already
need no verification.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyproof.llm.common import RollingHash, checkpointed, mixed, total_bytes, word_bounds, word_hashes
from tallyproof.llm.components import components
from tallyproof.llm.winnow import Documents, Sizes

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SALT = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Shingles:
    """words: of a shingle; percent: least similarity. crowd: a signature of more nodes is left to the prefix filter.
    spare: share of segments beyond the pigeonhole's need, so that common ones can be skipped."""

    words: int = 5
    percent: int = 75
    crowd: int = 48
    spare: float = 0.35
    sizes: Sizes = Sizes(bucket=12 << 20)


# ------------------------------------------------------------------ sets of a batch


class Sets:
    """The shingle sets of a batch: tokens in order of document, distinct within one; size of each; node (set hash)."""

    def __init__(self, table: pa.Table, cfg: Shingles):
        self.docs = docs = Documents.of(table, b"\n")
        data = np.frombuffer(docs.data.translate(_LOWER), dtype=np.uint8)
        start, end = word_bounds(data)
        roll = RollingHash(word_hashes(data, start, end))
        first, last = np.searchsorted(start, docs.starts), np.searchsorted(start, docs.ends)
        grams = mixed(roll.of(np.arange(max(0, len(start) - cfg.words + 1)), np.arange(cfg.words, max(cfg.words, len(start) + 1))))
        pieces = []
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= cfg.words:
                pieces.append(np.unique(grams[a : b - cfg.words + 1]))
            elif b > a:
                pieces.append(mixed(roll.of(np.array([a]), np.array([b])) + np.uint64(b - a)))
            else:
                pieces.append(np.zeros(0, dtype=np.uint64))
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.tokens = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint64)
        self.ends = np.cumsum(self.size)
        self.owner = np.repeat(np.arange(len(pieces)), self.size)
        total = np.zeros(len(pieces), dtype=np.uint64)
        np.add.at(total, self.owner, mixed(self.tokens ^ _SALT))
        self.node = mixed(total + self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def tokens_of(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i] - self.size[i] : self.ends[i]]


# ------------------------------------------------------------------ bands and signatures


def band_starts(most: int, percent: int) -> list[int]:
    """Least sizes of the bands up to size ``most``: a set's partners lie in its own band or a neighbouring one."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return out


@dataclass(frozen=True)
class Plan:
    """Of one group, which joins the sets of a band with each other and with the next band. deletions: signatures are
    segments and their one-deletion neighbours, instead of segments alone."""

    segments: int
    deletions: bool


def difference(a: int, b: int, percent: int) -> int:
    """Most elements in the symmetric difference of sets of these sizes with at least that similarity."""
    return (a + b) * (100 - percent) // (100 + percent)


def allocate(largest: int, cfg: Shingles) -> Plan:
    """The cheaper plan for a group whose lower band ends at ``largest``."""
    partner = largest * 100 // cfg.percent
    h = difference(largest, partner, cfg.percent)
    plain, paired = math.ceil((1 + cfg.spare) * (h + 1)) + 2, h // 2 + 2
    mean = largest / plain
    thin = math.exp(-mean) * (1 + mean)  # share of segments with fewer than two shingles
    if plain * (1 + thin) <= paired * (1 + largest / paired):
        return Plan(plain, False)
    return Plan(paired, True)


class Signatures:
    """Signatures of the distinct nodes of a batch: key, node and group of each; and each node's margin in its groups."""

    def __init__(self, sets: Sets, cfg: Shingles):
        _, first = np.unique(sets.node, return_index=True)
        first = first[sets.size[first] > 0]
        most = int(sets.size.max(initial=0))
        starts = band_starts(most, cfg.percent)
        plans = [allocate(starts[b + 1] - 1, cfg) for b in range(len(starts) - 1)]
        band = np.searchsorted(starts, sets.size, side="right") - 1
        chosen = np.zeros(len(sets.size), dtype=bool)
        chosen[first] = True
        keys, nodes, roles, self.filled, self.margins = [], [], [], {}, {}
        for shift in (0, 1):  # a set is in the lower band of one group and in the upper band of another
            group = band - shift
            docs = np.flatnonzero(chosen & (group >= 0))
            if not len(docs):
                continue
            table = np.array([(p.segments, p.deletions) for p in plans], dtype=np.int64)
            segments, deletions = table[group[docs], 0], table[group[docs], 1] > 0
            base = np.zeros(len(sets.size), dtype=np.int64)
            base[docs] = np.cumsum(segments) - segments
            used = chosen[sets.owner] & (group[sets.owner] >= 0)
            tokens, owner = sets.tokens[used], sets.owner[used]
            count = np.zeros(len(sets.size), dtype=np.int64)
            count[docs] = segments
            value = mixed(tokens ^ np.uint64(0xE7037ED1A0B428DB))
            slot = base[owner] + ((value >> np.uint64(20)) % count[owner].astype(np.uint64)).astype(np.int64)
            content = np.zeros(int(segments.sum()), dtype=np.uint64)
            np.add.at(content, slot, value)
            full = np.bincount(slot, minlength=len(content))
            doc = np.repeat(docs, segments)
            number = np.arange(len(content)) - base[doc]
            place = mixed((group[doc].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
            by_deletion = np.zeros(len(sets.size), dtype=bool)
            by_deletion[docs] = deletions
            sent = (full > 0) | by_deletion[doc]
            keys.append(mixed(content[sent] + place[sent]))
            nodes.append(doc[sent])
            roles.append(np.full(len(nodes[-1]), shift))
            less = by_deletion[owner]
            keys.append(mixed(content[slot[less]] - value[less] + place[slot[less]]))
            nodes.append(owner[less])
            roles.append(np.full(len(nodes[-1]), shift))
            # How many signatures a node can do without.
            size = sets.size[docs]
            ends = np.array([starts[b + 1] - 1 for b in range(len(plans))])
            partner = size * 100 // cfg.percent if shift == 0 else np.minimum(size, ends[group[docs]])
            h = (size + partner) * (100 - cfg.percent) // (100 + cfg.percent)
            filled = np.bincount(doc[full > 0], minlength=len(sets.size))[docs]
            margin = np.where(deletions, segments - h // 2 - 1, filled - h - 1)
            self.margins[shift] = (docs, margin)
            self.filled[shift] = (docs, np.where(deletions, 0, filled))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        self.docs = np.concatenate(nodes) if nodes else np.zeros(0, dtype=np.int64)
        self.roles = np.concatenate(roles) if roles else np.zeros(0, dtype=np.int64)


_NODES = "doc_id long, row long, node long, n long, margin0 long, margin1 long, filled0 long, filled1 long"
_ASKS = "bucket long, keys binary, nodes binary, runs binary"
_FOUND = "a long, b long, role int, n long"


def _in_batches(batches, size: int):
    """Tables of about ``size`` bytes of text."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum([0 if (t := x.as_buffer()) is None else t.size for x in batch.column("text")]) // size
        edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield table.slice(a, b - a)


def document_nodes(docs: DataFrame, cfg: Shingles) -> DataFrame:
    """doc_id, row (hash of doc_id and text), node, n (shingles), and by role (0: lower band of a group, 1: upper):
    margin (signatures the node can do without) and filled (segments with shingles; 0 where deletions are used)."""

    def nodes(batches):
        for table in _in_batches(batches, cfg.sizes.batch):
            table = table.sort_by([("doc_id", "ascending")])
            sets = Sets(table, cfg)
            s = Signatures(sets, cfg)
            out = {}
            for name, values, empty in (("margin", s.margins, 1 << 20), ("filled", s.filled, 0)):
                for role in (0, 1):
                    by_node = {}
                    if role in values:
                        by_node = dict(zip(sets.node[values[role][0]].tolist(), values[role][1].tolist()))
                    out[f"{name}{role}"] = pa.array([by_node.get(n, empty) for n in sets.node.tolist()], pa.int64())
            rows = table.column("row").to_pylist()
            of = {}
            for r, d, t in zip(rows, table.column("doc_id").to_pylist(), table.column("text").to_pylist()):
                of.setdefault((d, t or ""), []).append(r)
            order = [of[d, sets.docs.data[a:b].decode("utf-8", "surrogatepass")].pop() for d, a, b in zip(sets.docs.ids, sets.docs.starts.tolist(), sets.docs.ends.tolist())]
            columns = [pa.array(sets.docs.ids, pa.int64()), pa.array(order, pa.int64()), pa.array(sets.node), pa.array(sets.size), *(out[n] for n in ("margin0", "margin1", "filled0", "filled1"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "n", "margin0", "margin1", "filled0", "filled1"])

    return docs.mapInArrow(nodes, _NODES)


def candidates(docs: DataFrame, buckets: int, cfg: Shingles) -> DataFrame:
    """a, b, role, n: nodes a (role 0) and b (of that role) share n signatures. A null b: n signatures of node a in that
    role are crowded.

    Signatures travel packed, five bytes each, with a node, size and length for each run of them; a chance match is
    only one more candidate. Two nodes in the upper band of a group are left to the group where that band is lower.
    """

    def ask(batches):
        for table in _in_batches(batches, cfg.sizes.batch):
            sets = Sets(table, cfg)
            s = Signatures(sets, cfg)
            bucket = (s.keys % np.uint64(buckets)).astype(np.int64)
            run = 2 * s.docs + s.roles
            by = np.lexsort((run, bucket))
            rows: dict[str, list] = {n: [] for n in ("bucket", "keys", "nodes", "runs")}
            key, run, bucket = s.keys[by] // np.uint64(buckets), run[by], bucket[by]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(at, [*at[1:], len(by)]):
                heads = np.flatnonzero(np.diff(run[a:b], prepend=-1))
                head = run[a:b][heads]
                low = key[a:b]
                rows["bucket"].append(int(bucket[a]))
                rows["keys"].append((low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((low >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes())
                rows["nodes"].append(sets.node[head >> 1].tobytes())
                rows["runs"].append(np.stack([np.diff([*heads, b - a]), sets.size[head >> 1], head & 1]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), *(pa.array(rows[n], pa.binary()) for n in ("keys", "nodes", "runs"))], names=list(rows))

    def match(table: pa.Table) -> pa.Table:
        keys, nodes, sizes, roles = [], [], [], []
        for k, n, r in zip(*(table.column(c).to_pylist() for c in ("keys", "nodes", "runs"))):
            count = len(k) // 5
            keys.append(np.frombuffer(k, "<u4", count).astype(np.uint64) | (np.frombuffer(k, np.uint8, count, 4 * count).astype(np.uint64) << np.uint64(32)))
            runs, size, role = np.frombuffer(r, "<u4").reshape(3, -1)
            nodes.append(np.repeat(np.frombuffer(n, np.int64), runs))
            sizes.append(np.repeat(size.astype(np.int64), runs))
            roles.append(np.repeat(role.astype(np.int8), runs))
        key, node, size, role = map(np.concatenate, (keys, nodes, sizes, roles))
        by = np.argsort(key, kind="stable")
        key = key[by]
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        by, key = by[shared], key[shared]
        node, size, role = node[by], size[by], role[by]
        by = np.lexsort((node, role, key))  # copies of a node in several batches fall together
        key, node, size, role = key[by], node[by], size[by], role[by]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (role[1:] != role[:-1])
        key, node, size, role = key[new], node[new], size[new], role[new]
        group = np.zeros(len(key), dtype=np.int64)
        group[1:] = np.cumsum(key[1:] != key[:-1])
        many = np.bincount(group, minlength=1)[group]
        crowded, times = np.unique(np.stack([node, role.astype(np.int64)])[:, many > cfg.crowd], axis=1, return_counts=True)
        keep = (many > 1) & (many <= cfg.crowd)
        group, node, size, role = group[keep], node[keep], size[keep], role[keep]
        found = [np.zeros((3, 0), dtype=np.int64)]
        for gap in range(1, cfg.crowd):  # members of one small group, a fixed distance apart
            near = np.flatnonzero(group[gap:] == group[:-gap]) if len(group) > gap else np.zeros(0, np.int64)
            if not len(near):
                break
            a, b = size[near], size[near + gap]
            near = near[(role[near] == 0) & (100 * np.minimum(a, b) >= cfg.percent * np.maximum(a, b))]
            found.append(np.stack([node[near], node[near + gap], role[near + gap].astype(np.int64)]))
        pairs = np.concatenate(found, axis=1)
        by = np.lexsort(pairs)
        pairs = pairs[:, by]
        new = np.ones(pairs.shape[1], dtype=bool)
        new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
        heads = np.flatnonzero(new)
        n = np.diff([*heads, pairs.shape[1]])
        pairs = pairs[:, new]
        nobody = pa.nulls(len(times), pa.int64())
        return pa.table(
            [
                pa.array(np.concatenate([pairs[0], crowded[0]])),
                pa.chunked_array([pa.array(pairs[1]), nobody]),
                pa.array(np.concatenate([pairs[2], crowded[1]]).astype(np.int32)),
                pa.array(np.concatenate([n, times]).astype(np.int64)),
            ],
            names=["a", "b", "role", "n"],
        )

    return docs.select("doc_id", "text").mapInArrow(ask, _ASKS).groupBy("bucket").applyInArrow(match, _FOUND)


# ------------------------------------------------------------------ verification


def _set_of(text: str, cfg: Shingles) -> np.ndarray:
    return Sets(pa.table({"doc_id": pa.array([0], pa.int64()), "text": [text]}), cfg).tokens


def _words_of(text: str, cfg: Shingles) -> set[bytes]:
    words = [w for w in re.split(rb"[ \t-\r]+", text.encode("utf-8", "surrogatepass").translate(_LOWER)) if w]
    if 0 < len(words) < cfg.words:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + cfg.words]) for i in range(len(words) - cfg.words + 1)}


def verify(pairs: DataFrame, texts: DataFrame, cfg: Shingles) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough: first by shingle hashes, then, where these agree, by the
    words themselves. A node's text goes to its pairs; sets are made there."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        known: dict[int, np.ndarray] = {}
        exact: dict[int, set[bytes]] = {}
        for batch in batches:
            links = []
            for a, b, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if len(known) > 400:
                    known.clear()
                    exact.clear()
                for node, text in ((a, s), (b, t)):
                    if node not in known:
                        known[node] = _set_of(text, cfg)
                x, y = known[a], known[b]
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked = 100 * same >= cfg.percent * (len(x) + len(y) - same)
                if linked:
                    for node, text in ((a, s), (b, t)):
                        if node not in exact:
                            exact[node] = _words_of(text, cfg)
                    x, y = exact[a], exact[b]
                    same = len(x & y)
                    linked = 100 * same >= cfg.percent * (len(x) + len(y) - same)
                links.append(linked)
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links: only the components that they join are worked on."""
    if labels is None:
        return checkpointed(components(links))
    named = links.join(labels.toDF("a", "_ca"), "a", "left").join(labels.toDF("b", "_cb"), "b", "left")
    edges = checkpointed(named.selectExpr("coalesce(_ca, a) as a", "coalesce(_cb, b) as b").filter("a <> b").distinct())
    if edges.isEmpty():
        return labels
    joined = components(edges).toDF("component", "_to")
    ends = links.selectExpr("a as node").unionByName(links.selectExpr("b as node")).distinct().join(labels, "node", "left_anti").selectExpr("node", "node as component")
    return checkpointed(labels.unionByName(ends).join(joined, "component", "left").selectExpr("node", "coalesce(_to, component) as component"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    out = pairs.join(labels.toDF("a", "_ca"), "a", "left").join(labels.toDF("b", "_cb"), "b", "left")
    return out.filter("coalesce(_ca, a) <> coalesce(_cb, b)").select("a", "b")


def _reach(cfg: Shingles) -> str:
    """Condition on places k, _ka of a common token in nodes of n, _na shingles: if it is their first common one, they
    share no more than what follows it in either, which must be enough."""
    return f"100 * least(n, _na) >= {cfg.percent} * greatest(n, _na) and {100 + cfg.percent} * (least(n - k, _na - _ka) + 1) >= {cfg.percent} * (n + _na)"


def _leader_pairs(groups: DataFrame, cfg: Shingles) -> DataFrame:
    """a, b: every member of a token group with its leader, the node in which the token is least rare: the one with
    the fewest shingles of its own, to which near copies are nearest."""
    leaders = groups.groupBy("token").agg(F.min(F.struct("k", "node", "n")).alias("_l")).selectExpr("token", "_l.node as a", "_l.k as _ka", "_l.n as _na")
    pairs = groups.join(leaders, "token").filter(f"node <> a and {_reach(cfg)}")
    return pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _open_pairs(groups: DataFrame, labels: DataFrame, cfg: Shingles) -> DataFrame:
    """a, b: members of one token group that are still in different components and may be similar.

    One of the two is outside the group's largest component. The smaller one needs a shorter prefix than the larger.
    """
    placed = groups.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("token", "component").agg(F.count("*").alias("_members"))
    open_ = parts.groupBy("token").agg(F.max_by("component", F.struct("_members", "component")).alias("_largest"), F.count("*").alias("_parts")).filter("_parts > 1")
    members = checkpointed(placed.join(open_.select("token", "_largest"), "token").withColumn("outside", F.expr("component <> _largest")))
    short = members.filter(f"k <= n - ({2 * cfg.percent} * n + {99 + cfg.percent}) div {100 + cfg.percent} + 1")
    small = short.select("token", F.col("node").alias("a"), F.col("n").alias("_na"), F.col("k").alias("_ka"), F.col("component").alias("_ca"), F.col("outside").alias("_out"))
    large = members.select("token", "node", "n", "k", "component", "outside")
    both = small.filter("_out").join(large, "token").unionByName(small.filter("not _out").join(large.filter("outside"), "token"))
    met = both.filter(f"(_na < n or (_na = n and a < node)) and component <> _ca and {_reach(cfg)}")
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _prefixes(texts: DataFrame, cfg: Shingles) -> DataFrame:
    """token, node, n, k (place by rarity) of the rarest shingles of the nodes in ``texts``: as many that similar sets share one. Tokens that one
    node has are left out at the end, not before: they fill a prefix too."""
    def explode(batches):
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                tokens = _set_of(text, cfg).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), node)), pa.array(np.full(len(tokens), len(tokens))), pa.array(tokens)], names=["node", "n", "token"])

    tokens = checkpointed(texts.mapInArrow(explode, "node long, n long, token long"))
    counted = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")), "token")
    order = Window.partitionBy("node").orderBy("df", "token")
    prefix = counted.withColumn("k", F.row_number().over(order)).filter(f"k <= n - ceil({cfg.percent} * n / 100) + 1 and df > 1")
    return prefix.select("token", "node", "n", F.col("k").cast("long").alias("k"))


def jaccard_components(docs: DataFrame, cfg: Shingles = Shingles()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) of every row of ``docs``.

    Null and empty texts, and texts without words, have no shingles and link with nothing. Texts shorter than a shingle
    are one. Repeated rows link like other copies. A null doc_id never is a component_id unless nothing else is there.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    nodes = checkpointed(document_nodes(rows, cfg))
    counted = candidates(docs, total_bytes(docs) // cfg.sizes.bucket + 1, cfg).groupBy("a", "b", "role").agg(F.sum("n").alias("n"))
    found = checkpointed(counted)
    crowded = found.filter("b is null").groupBy("a").agg(*[F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).alias(f"crowded{r}") for r in (0, 1)])
    homes = nodes.filter("n > 0").groupBy("node").agg(*[F.min(c).alias(c) for c in ("row", "n", "margin0", "margin1", "filled0", "filled1")])
    homes = checkpointed(homes.join(crowded.withColumnRenamed("a", "node"), "node", "left").na.fill(0, ["crowded0", "crowded1"]))
    # A similar pair shares as many signatures as either has left after the crowded and the differing ones.
    left = homes.selectExpr("node as a", "n as _na", "filled0 - crowded0 as _left")
    right = homes.selectExpr("node as b", "n as _nb", "filled0 - crowded0 as _right0", "filled1 - crowded1 as _right1")
    h = f"(_na + _nb) * {100 - cfg.percent} div {100 + cfg.percent}"
    enough = f"n >= greatest(_left, case when role = 0 then _right0 else _right1 end) - {h}"
    pairs = found.filter("b is not null").join(left, "a").join(right, "b").filter(enough)
    pairs = checkpointed(pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b", "n").groupBy("a", "b").agg(F.max("n").alias("n")))
    crowd = checkpointed(homes.filter("crowded0 > margin0 or crowded1 > margin1").select("node"))
    wanted = pairs.selectExpr("a as node").unionByName(pairs.selectExpr("b as node")).unionByName(crowd).distinct()
    texts = checkpointed(rows.join(homes.join(wanted, "node").select("node", "row"), "row").dropDuplicates(["node"]).select("node", "text"))
    # First one pair for each node, and each token group's members with its leader: a large group of copies becomes
    # a tree, not all its pairs.
    first = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    crowded_groups = None
    if not crowd.isEmpty():
        crowded_groups = checkpointed(_prefixes(texts.join(crowd, "node"), cfg))
        first = first.unionByName(_leader_pairs(crowded_groups, cfg)).distinct()
    first = checkpointed(first)
    labels = merged(None, checkpointed(verify(first, texts, cfg)))
    rest = _apart(pairs, labels)
    if crowded_groups is not None:
        rest = rest.unionByName(_open_pairs(crowded_groups, labels, cfg)).distinct()
    rest = checkpointed(rest.join(first, ["a", "b"], "left_anti"))
    labels = merged(labels, checkpointed(verify(rest, texts, cfg)))

    labelled = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return labelled.join(smallest, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, cfg: Shingles = Shingles()) -> DataFrame:
    """The rows of ``docs``, of each component only the one with the smallest doc_id (null last, then by text hash).

    Documents without shingles all stay, but for repeated rows (equal doc_id and text), of which one stays.
    """
    names = docs.columns
    doc, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    own = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumns({"_row": F.xxhash64(doc, text), "_second": F.xxhash64(doc, text, F.lit(7))})
    rows = jaccard_components(own.select(F.col("_row").alias("doc_id"), F.col(text).alias("text")), cfg)
    ids = own.select(F.col("_row"), F.col(doc).alias("_doc"))
    order = F.struct(F.col("_doc").isNull(), F.col("_doc"), F.col("doc_id"))
    kept = rows.join(ids, rows.doc_id == ids._row).groupBy("component_id").agg(F.min_by("doc_id", order).alias("_kept"))
    out = own.join(kept, F.col("_row") == F.col("_kept"), "left_semi").dropDuplicates(["_row", "_second"])
    return out.drop("_row", "_second").toDF(*names)
