"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles.  Tokens have one global order: class 1 (hash in the counted
share of the hash space, document frequency under the threshold) before class 2 (all others), by hash within a class.
A set of n tokens may miss d = n - ceil(t * n) of them in a linked partner.  Its prefix is extended until it offers
d + 1 units of cover: a class-1 token is one unit by itself; class-2 tokens are dealt to bins by hash, and every
token of a bin after the first is a unit, because a partner must miss all but one of a bin's tokens to share no
2-combination of it.  So two linked sets share a class-1 token or a class-2 combination of their prefixes, whatever
the classes are; which class a token has decides cost only, never results.  The smaller set of a pair may miss fewer
tokens, n - ceil(2t / (1 + t) * n), so only the start of its prefix counts; postings carry that as a flag.  Candidates
are verified on their sets.

Frequencies are counted over all documents.  Exact copies (equal sets) are one class, represented by the smallest
doc_id.  A posting list up to ``small`` classes gives its pairs; a longer one gives a star around the class with the
fewest class-1 tokens (the least edited copy).  All long lists of one centre are one group, in which a member stands
once however many lists it shares, so the many lists of a group of near copies cost the group's size.  A later round
tries a further centre against members that aren't connected yet.  For what no round connects, each pair once: two
members share at most as many tokens of the centre as the one with fewer of them has, so a link that asks for more than
that shares a token that the centre lacks.  Such tokens come from edits and are rare; members meet by them, and a member
that must share r of them meets by all but the r - 1 most frequent ones in the group.  Only pairs that the centre's tokens
alone could link are compared member by member.

Identity of hashes.  Shingles are told by 64 bits, a set in the posting lists by the 64-bit sum of its mixed shingles
(two sets that meet there are both followed, and both are verified), exact copies by 128 bits, and verification compares
48 bits of each shingle: a pair that falls short by j shared shingles passes wrongly with a chance below
(n * m / 2**48) ** j, for sets of n and m shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, release, written
from .graph import components
from .textblocks import U, chunks, mix, shingle_sets, sums

_SALT = [U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_MARKS = 1 << 25  # bits of the map of wanted ids, and ids that it serves; beyond them ids are joined
_RANGE = 128 << 20  # bytes of text for each range of hashes: bounds what one task gathers


def _packed(token: np.ndarray, times: np.ndarray) -> bytes:
    """Rising tokens of a block and how often each comes: steps of 16 bits, longer ones apart; counts only above one."""
    step = np.diff(token.astype(np.int64), prepend=0)
    far, many = step >= 65535, np.flatnonzero(times > 1)
    head = np.array([len(token), far.sum(), len(many)], "<u4")
    return b"".join(x.tobytes() for x in (head, np.where(far, 65535, step).astype("<u2"), step[far].astype("<u4"), many.astype("<u4"), times[many].astype("<u4")))


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, far, many = np.frombuffer(block, "<u4", 3).tolist()
    step = np.frombuffer(block, "<u2", n, 12).astype(np.int64)
    at = 12 + 2 * n
    step[step == 65535] = np.frombuffer(block, "<u4", far, at)
    times = np.ones(n, np.int64)
    times[np.frombuffer(block, "<u4", many, at + 4 * far)] = np.frombuffer(block, "<u4", many, at + 4 * (far + many))
    return np.cumsum(step).astype(np.uint32), times


def _scan(width: int, counted: int, parts: int):
    """Per document (doc_id, n, lo, hi); per block of documents the counts of the tokens of each hash range (p >= 0).

    A token stands in a block once, however many of its documents have it.
    """

    def pack(tokens: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        flat = np.sort(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint32)
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        token, times = flat[first], np.diff(np.r_[first, len(flat)])
        edge = np.searchsorted(token, np.ceil(np.arange(parts + 1) * (counted / parts)).astype(np.int64))
        for p in range(parts):
            if edge[p] < edge[p + 1]:
                yield p, _packed(token[edge[p] : edge[p + 1]], times[edge[p] : edge[p + 1]])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, data, offsets in chunks(batch):
                token, bound = shingle_sets(data, offsets, width)
                n = np.diff(bound)
                lo, hi = (sums(mix(token ^ s), bound).view(np.int64) for s in _SALT[:2])
                yield _rows(ids.slice(a, b - a), n, lo, hi)
                high = (token >> U(32)).astype(np.uint32)
                held.append(high[high < counted])
                size += len(held[-1])
                if size > 4_000_000:
                    yield _blocks(list(pack(held)))
                    held, size = [], 0
        if size:
            yield _blocks(list(pack(held)))
        held = []
        release()

    return run


_SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("p", pa.int32()), ("payload", pa.binary())])


def _rows(ids, n, lo, hi) -> pa.RecordBatch:
    none = pa.nulls(len(n))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(lo), pa.array(hi), none.cast(pa.int32()), none.cast(pa.binary())], schema=_SCAN)


def _blocks(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    none = pa.nulls(len(blocks)).cast(pa.int64())
    return pa.RecordBatch.from_arrays([none] * 4 + [pa.array([p for p, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], schema=_SCAN)


def _grouped(batches) -> Iterator[tuple[int, list[bytes]]]:
    """Payloads by p, from rows sorted by p."""
    at, held = None, []
    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != at and held:
                yield at, held
                held = []
            at = p
            held.append(x)
    if held:
        yield at, held


def _frequent(least: int):
    def run(batches):
        for _, blocks in _grouped(batches):
            found = [_unpacked(x) for x in blocks]
            token, times = (np.concatenate(x) for x in zip(*found))
            del found
            order = np.argsort(token, kind="stable")
            token, times = token[order], times[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            df = np.add.reduceat(times, first)
            keep = df >= least
            yield pa.RecordBatch.from_arrays([pa.array(token[first[keep]].astype(np.int64)), pa.array(df[keep].astype(np.int64))], ["token", "df"])

    return run


def _levels(num: int, den: int, n: int) -> list[tuple[int, int]]:
    """(level, bins) under which a set of n tokens indexes its class-2 combinations.

    Levels end where sizes have grown by den / num, so linked sets share a level of their two.  The bins of a level
    follow from the smallest size that uses it: at most ceil(t * size) - 1, which leaves enough cover in any set.
    """
    tops, level = [2, 2], 0
    while tops[-1] <= n:
        tops.append(max(tops[-1] + 1, tops[-1] * den // num))
    level = len(tops)
    tops.append(tops[-1])
    return [(k, max(1, min(-(-num * m // den) - 1, 2 * m // 5))) for k, m in ((level, tops[max(0, level - 3)]), (level + 1, tops[level - 2]))]


def _signatures(width: int, num: int, den: int, counted: int, parts: int, frequent):
    """Blocks (p, payload) of prefix signatures with the sets that have them."""

    def combine(token: np.ndarray, need: int, n: int, near: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Combinations that give ``need`` units, and whether they lie in the prefix that gives ``near`` units."""
        out = []
        for level, bins in _levels(num, den, n):
            dealt = (mix(token ^ _SALT[2]) % U(bins)).astype(np.int64)
            cover = np.ones(len(token), np.int64)
            cover[np.unique(dealt, return_index=True)[1]] = 0
            cover = np.cumsum(cover)
            to = int(np.searchsorted(cover, need)) + 1
            close = int(np.searchsorted(cover, near)) + 1 if near > 0 else 0
            order = np.argsort(dealt[:to], kind="stable")
            bin_, part, k = dealt[order], token[:to][order], 1
            while k < len(part) and (same := bin_[k:] == bin_[:-k]).any():
                tag = U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                out.append((mix(part[:-k][same] * _SALT[0] + part[k:][same] * _SALT[1] + tag), order[k:][same] < close))
                k += 1
        return out

    def run(batches):
        often = frequent.value
        coarse = np.zeros(1 << 24, bool)
        coarse[often >> 8] = True

        def signed(data, offsets) -> Iterator[tuple]:
            token, bound = shingle_sets(data, offsets, width)
            n = np.diff(bound)
            lo = sums(mix(token ^ _SALT[0]), bound)
            high = (token >> U(32)).astype(np.uint32)
            first = high < counted
            maybe = np.flatnonzero(first)
            maybe = maybe[coarse[high[maybe] >> 8]]
            if len(often):
                first[maybe[often[np.minimum(np.searchsorted(often, high[maybe]), len(often) - 1)] == high[maybe]]] = False
            need = n - (num * n + den - 1) // den + 1
            near = n - (2 * num * n + num + den - 1) // (num + den) + 1
            before = np.r_[0, np.cumsum(first)]
            at = np.flatnonzero(first)
            doc = np.repeat(np.arange(len(n)), n)[at]
            rank = np.arange(len(at)) - before[bound[doc]]
            use = (rank < need[doc]) & (n[doc] > 1)
            sig, flag, doc = [mix(token[at[use]] ^ _SALT[3])], [rank[use] < near[doc[use]]], [doc[use]]
            have = before[bound[1:]] - before[bound[:-1]]
            for d in np.flatnonzero((have < need) & (n > 1)):
                rest = token[bound[d] : bound[d + 1]][~first[bound[d] : bound[d + 1]]]
                for x, f in combine(rest, int(need[d] - have[d]), int(n[d]), int(near[d] - have[d])):
                    sig.append(x)
                    flag.append(f)
                    doc.append(np.full(len(x), d))
            yield np.concatenate(sig) << U(1) | np.concatenate(flag), np.concatenate(doc), lo, n, have

        def flush(held) -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0] + [len(x[2]) for x in held])
            sig = np.concatenate([x[0] for x in held])
            doc = np.concatenate([x[1] + b for x, b in zip(held, base)])
            lo, n, own = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
            single = np.zeros(len(lo), bool)
            single[np.unique(lo, return_index=True)[1]] = True
            keep = single[doc]
            sig, doc = sig[keep], doc[keep]
            to = ((sig >> U(1)) % U(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            sig, doc = ((sig >> U(1)) // U(parts) << U(1) | sig & U(1))[order] & U((1 << 40) - 1), doc[order]
            edge = np.searchsorted(to[order], np.arange(parts + 1))
            ps, out = [], []
            for p in range(parts):
                a, b = edge[p], edge[p + 1]
                if b > a:
                    who, at = np.unique(doc[a:b], return_inverse=True)
                    out.append(b"".join(x.tobytes() for x in (np.array([b - a, len(who)], "<u4"), lo[who], n[who].astype("<u4"), own[who].astype("<u4"), at.astype("<u4" if len(who) > 65535 else "<u2"), (sig[a:b] & U(255)).astype(np.uint8), (sig[a:b] >> U(8)).astype("<u4"))))
                    ps.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(out, pa.binary())], ["p", "payload"])

        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch):
                for x in signed(data, offsets):
                    held.append(x)
                    size += len(x[0])
                if size > 1_000_000:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
        held = []
        release()

    return run


def _postings(num: int, den: int, small: int):
    """Candidate pairs (a, b), and the members b of the long posting lists with centre a (hub true, rare, flag)."""

    def run(batches):
        for _, blocks in _grouped(batches):
            sig, who, lo, n, own, base = [], [], [], [], [], 0
            for x in blocks:
                k, d = (int(v) for v in np.frombuffer(x, "<u4", 2))
                at, wide = 8 + 16 * d, 4 if d > 65535 else 2
                lo.append(np.frombuffer(x, "<u8", d, 8))
                n.append(np.frombuffer(x, "<u4", d, 8 + 8 * d).astype(np.int64))
                own.append(np.frombuffer(x, "<u4", d, 8 + 12 * d).astype(np.int64))
                who.append(np.frombuffer(x, f"<u{wide}", k, at).astype(np.int64) + base)
                at += k * wide
                sig.append(np.frombuffer(x, np.uint8, k, at).astype(U) | np.frombuffer(x, "<u4", k, at + k).astype(U) << U(8))
                base += d
            sig, who, lo, n, own = (np.concatenate(x) for x in (sig, who, lo, n, own))
            order = np.argsort(sig >> U(1), kind="stable")
            sig, who = sig[order], who[order]
            same = sig[1:] >> U(1) == sig[:-1] >> U(1)
            keep = np.r_[same, False] | np.r_[False, same]
            sig, who = sig[keep], who[keep]
            if not len(sig):
                continue
            order = np.lexsort((lo[who], sig >> U(1)))
            sig, who = sig[order], who[order]
            flag, sig, l = (sig & U(1)).astype(bool), sig >> U(1), lo[who]
            keep = np.r_[True, (sig[1:] != sig[:-1]) | (l[1:] != l[:-1])]
            sig, l, flag, m, rare = sig[keep], l[keep], flag[keep], n[who[keep]], own[who[keep]]
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            length = np.diff(np.r_[start, len(sig)])
            short = np.repeat(length <= small, length)
            pairs = []
            for k in range(1, small):
                at = np.flatnonzero((sig[k:] == sig[:-k]) & short[k:])
                if not len(at):
                    break
                x, y = m[at], m[at + k]
                fit = (den * np.minimum(x, y) >= num * np.maximum(x, y)) & (flag[at] | (y < x)) & (flag[at + k] | (x < y))
                pairs.append(np.stack([l[at[fit]], l[at[fit] + k]], 1))
            if pairs and len(pairs := np.concatenate(pairs)):
                key = mix(pairs[:, 0] * _SALT[0] + pairs[:, 1])
                pairs = pairs[np.unique(key, return_index=True)[1]]
                yield _found(False, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), np.ones(len(pairs), bool))
            group = [], [], [], []
            for a, c in zip(start[length > small].tolist(), length[length > small].tolist()):
                f, x = flag[a : a + c], m[a : a + c]
                if f.any():
                    use = a + np.flatnonzero(f | (x > x[f].min()))
                    if len(use) > 1:
                        centre = l[use[np.lexsort((l[use], rare[use]))[0]]]
                        for column, value in zip(group, (np.full(len(use), centre), l[use], rare[use], flag[use])):
                            column.append(value)
            if group[0]:
                centre, member, own_, near = (np.concatenate(x) for x in group)
                order = np.lexsort((~near, member, centre))  # a member is near in its group where any list says so
                centre, member = centre[order], member[order]
                once = np.flatnonzero(np.r_[True, (centre[1:] != centre[:-1]) | (member[1:] != member[:-1])])
                for i in range(0, len(once), 65536):
                    at = once[i : i + 65536]
                    yield _found(True, centre[at], member[at], own_[order[at]], near[order[at]])

    return run


def _found(hub: bool, a, b, rare, flag) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hub)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(rare), pa.array(flag)], ["hub", "a", "b", "rare", "flag"])


def _sets(width: int, share: float, wanted):
    """(doc_id, n, tokens) of documents whose id may be wanted; tokens below ``share`` of the hash space, 6 bytes each."""

    def run(batches):
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            want = ids.is_valid().to_numpy(zero_copy_only=False)
            if bits is not None:
                bit = _bit_of(ids.fill_null(0).to_numpy())
                want = want & (bits[bit >> 3] >> (bit & 7)).astype(bool)
            few = batch.filter(pa.array(want))
            ids = few.column(few.schema.get_field_index("doc_id")).cast(pa.int64()).to_numpy()
            for a, b, data, offsets in chunks(few):
                token, bound = shingle_sets(data, offsets, width)
                low = np.r_[0, np.cumsum(token < U(int(share * (1 << 62)) << 2))] if share < 1 else np.arange(len(token) + 1)
                upto = bound[:-1] + low[bound[1:]] - low[bound[:-1]]
                cut = np.ascontiguousarray((token >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(np.diff(bound)), pa.array([cut[6 * x : 6 * y] for x, y in zip(bound[:-1].tolist(), upto.tolist())], pa.binary())], ["doc_id", "n", "tokens"])
        release()

    return run


def _bit_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) % U(_MARKS)).astype(np.int64)


def _marks(batches):
    """The distinct bits of ids, as (word, bit)."""
    for batch in batches:
        bit = np.unique(_bit_of(batch.column(0).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(np.left_shift(1, bit & 31))], ["word", "bit"])


def _gathered(df: DataFrame) -> list[np.ndarray]:
    """The columns of ``df``, numbers below 2**32, on the driver: 4 bytes a number, a row for each task.

    As rows of their own two million numbers take the driver hundreds of MB.
    """

    def run(batches):
        held = [[] for _ in range(columns)]
        for batch in batches:
            for k, x in enumerate(held):
                x.append(batch.column(k).to_numpy().astype("<u4"))
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in held], [f"c{k}" for k in range(columns)])

    columns = len(df.columns)
    rows = df.mapInArrow(run, ", ".join(f"c{k} binary" for k in range(columns))).collect()
    return [np.frombuffer(b"".join(r[k] for r in rows), "<u4") for k in range(columns)]


def _tokens(x: bytes) -> np.ndarray:
    """The tokens of 6 bytes that ``_sets`` gives."""
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _beside(batches):
    """(row of a member, inside, keys) from (row, its tokens, its centre's): how many it shares, and the others."""
    for batch in batches:
        x, y = batch.column(1), batch.column(2)
        inside, keys = [], []
        for i in range(len(x)):
            s, t = _tokens(x[i].as_py()), _tokens(y[i].as_py())
            own = t[np.minimum(np.searchsorted(t, s), len(t) - 1)] != s if len(t) else np.ones(len(s), bool)
            inside.append(len(s) - int(own.sum()))
            keys.append(s[own].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(inside, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "inside", "keys"])
    release()


def _verify(num: int, den: int):
    """The pairs whose overlap, with all tokens that weren't sent taken as shared, is enough."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            nx, ny = (batch.column(k).to_pylist() for k in (4, 5))
            keep = []
            for i in range(len(a)):
                s, t = _tokens(x[i].as_py()), _tokens(y[i].as_py())
                small, large = (s, t) if len(s) < len(t) else (t, s)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                both += min(nx[i] - len(s), ny[i] - len(t))
                keep.append(den * both >= num * (nx[i] + ny[i] - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])
        release()

    return run


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (75, 100), least: int = 24, capacity: int = 1 << 21,
    counted_share: float = 1.0, small: int = 24, rounds: int = 1, head: float = 0.3,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked where ``den * |A n B| >= num * |A u B|`` share a component.

    A null or empty text, or one of white space, has no shingles and is linked with nothing; a null doc_id is its own
    row with a null component.  Rows that repeat a doc_id with another text are separate sets of one document: the
    document's component is the smallest reachable from any.  Other columns are ignored.

    Very long texts are whole like any other, equal texts tie to the smallest doc_id, an empty table gives no rows.
    least, capacity: a token is frequent at a document frequency of ``least``, doubled until ``capacity`` tokens at
    most are frequent, which bounds the broadcast to 4 * capacity bytes.  small: posting lists up to this long are
    paired, longer ones are stars.  rounds: further centres for each group before its components are paired.
    """
    spark, (num, den) = docs.sparkSession, threshold
    bounded_batches(spark)
    counted = int(counted_share * (1 << 32))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _RANGE))
    scan = written(docs.mapInArrow(_scan(width, counted, parts), "doc_id long, n long, lo long, hi long, p int, payload binary"), "scan")
    member = scan.where("p is null").select("doc_id", "n", "lo", "hi")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, "p").sortWithinPartitions("p")

    often = written(dealt(scan.where("p is not null").select("p", "payload")).mapInArrow(_frequent(least), "token long, df long"), "often")
    by_level = {r[0]: r[1] for r in often.groupBy(F.floor(F.log2(F.col("df") / least)).alias("level")).count().collect()}
    level = 0
    while sum(c for k, c in by_level.items() if k >= level) > capacity:
        level += 1
    frequent = spark.sparkContext.broadcast(np.sort(_gathered(often.where(F.col("df") >= least << level).select("token"))[0]))

    # A set without an id can't be named, so it must not become the centre of a long posting list.
    signed = docs.where("doc_id is not null").mapInArrow(_signatures(width, num, den, counted, parts, frequent), "p int, payload binary")
    found = written(dealt(signed).mapInArrow(_postings(num, den, small), "hub boolean, a long, b long, rare long, flag boolean"), "found")

    node = written(member.where("n > 0 and doc_id is not null").groupBy("lo", "hi").agg(F.min("doc_id").alias("node"), F.max("n").alias("n")), "node")
    name = node.select("lo", "node", "n")

    def nodes(df: DataFrame, *keep: str) -> DataFrame:
        """Pairs of hashes as pairs of representatives whose sizes allow a link."""
        a, b = name.toDF("a", "na", "sa"), name.toDF("b", "nb", "sb")
        return df.join(a, "a").join(b, "b").select(*keep, F.col("na").alias("a"), F.col("nb").alias("b"), (den * F.least("sa", "sb") >= num * F.greatest("sa", "sb")).alias("fits"))

    group = found.where("hub").groupBy("a", "b").agg(F.max("rare").alias("rare"), F.max("flag").alias("flag"))
    group = written(nodes(group, "rare", "flag", "sb"), "group")
    pairs = found.where("not hub").select("a", "b").distinct()
    pairs = nodes(pairs).where("fits").select("a", "b").union(group.where("fits and a <> b").select("a", "b")).distinct()
    pairs = written(pairs, "pairs")

    def sets(ids: DataFrame, share: float, name: str) -> DataFrame:
        """Token sets of the documents ``ids`` (and a few more: they are told by a bit map of fixed size)."""
        ids = written(ids.toDF("doc_id").distinct(), "ids")
        if ids.count() > _MARKS // 8:
            return written(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(width, share, None), "doc_id long, n long, tokens binary"), name)
        word, bits = _gathered(ids.mapInArrow(_marks, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")))
        marks = np.zeros(_MARKS >> 5, "<u4")
        marks[word] = bits
        wanted = spark.sparkContext.broadcast(marks.tobytes())
        return written(docs.mapInArrow(_sets(width, share, wanted), "doc_id long, n long, tokens binary"), name)

    ends = F.explode(F.array("a", "b")).alias("id")
    heads = sets(pairs.select(ends).union(group.select(F.col("b").alias("id"))), head, "heads")

    def passed(df: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
        left, right = tokens.toDF("a", "nx", "x"), tokens.toDF("b", "ny", "y")
        return written(df.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "x", "y", "nx", "ny").mapInArrow(_verify(num, den), "a long, b long"), name)

    def verified(df: DataFrame) -> DataFrame:
        """First on the start of the sets, which bounds the overlap; what that leaves on whole sets."""
        close = passed(df, heads, "close").distinct()
        return passed(close, sets(close.select(ends), 1.0, "sets"), "links")

    same = member.where("n > 0 and doc_id is not null").join(node.select("lo", "hi", "node"), ["lo", "hi"]).select("doc_id", "node")
    several = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("doc_id", "a")
    links = same.join(several, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()
    links = _resolved(group, written(links.union(verified(pairs)), "links"), verified, sets, rounds, num, den)
    base = member.join(node.select("lo", "hi", "node"), ["lo", "hi"], "left").select("doc_id", "n", "node").join(components(links), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return base.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _between(state: DataFrame, sets, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of untried members in different components of a group that may link; all that do are among them.

    state: hub, id, component, flag, size, tried.  With n and m tokens, i and j of them in the centre, a pair shares at
    most min(i, j) tokens of the centre.
    """
    itself = F.col("id") == F.col("hub")
    facts = state.groupBy("hub").agg(F.min("size").alias("least"), F.max(F.when(itself, F.col("component"))).alias("own"), F.max(F.when(itself, F.col("size"))).alias("around"))
    rest = state.where("not tried").select("hub", "id", "component", "flag", "size").join(facts, "hub")
    rest = rest.withColumn("other", F.coalesce(F.col("component") != F.col("own"), F.lit(True))).drop("own", "around")
    ids = state.where("not tried").select("id").union(state.select("hub"))
    tokens = sets(ids, 1.0, "family")
    # Of a centre whose id stands for several texts one is taken: any set serves, the centre's own best.
    other = tokens.toDF("hub", "many", "y").join(facts.select("hub", "around"), "hub")
    centre = other.groupBy("hub").agg(F.min_by("y", F.struct(F.abs(F.col("many") - F.col("around")), "y")).alias("y"))
    # Files of sets that are alike are small, what they hold isn't: no side is to be broadcast for the size of its file.
    rows = rest.join(tokens.toDF("id", "n", "x").hint("merge"), "id").join(centre.hint("merge"), "hub")
    rows = rows.select(F.struct("hub", "id", "component", "flag", "size", "least", "other", "n").alias("row"), "x", "y")
    kind = rows.schema["row"].dataType.simpleString()
    rows = written(rows.mapInArrow(_beside, f"row {kind}, inside long, keys array<long>").select("row.*", "inside", "keys"), "beside")
    # At least this many of its other tokens a member shares with any partner that the centre's tokens alone don't link.
    due = F.greatest(F.lit(1), F.ceil(num * (F.col("n") + F.col("least")) / (num + den)) - F.col("inside"))
    each = rows.select("hub", "id", "component", "flag", "size", "other", due.cast("int").alias("due"), F.explode("keys").alias("key"))
    many = each.groupBy("hub", "key").agg(F.count("*").alias("df"), F.max("other").alias("met")).where("df > 1 and met").select("hub", "key", "df")
    each = written(each.hint("merge").join(many, ["hub", "key"]), "keys")
    mine = each.where("other").groupBy("hub", "id", "component", "flag", "size").agg(F.min("due").alias("due"), F.array_sort(F.collect_set(F.struct("df", "key"))).alias("keys"))
    mine = mine.where(F.size("keys") >= F.col("due")).withColumn("key", F.explode(F.slice("keys", F.lit(1), F.size("keys") - F.col("due") + 1)["key"])).drop("due", "keys")
    fits = f"a <> b and ca <> cb and (fa or sb < sa) and (fb or sa < sb) and {den} * least(sa, sb) >= {num} * greatest(sa, sb)"
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def sided(df: DataFrame, side: str, *more) -> DataFrame:
        names = {"id": side, "component": f"c{side}", "flag": f"f{side}", "size": f"s{side}"}
        return df.select("hub", *more, *[F.col(k).alias(v) for k, v in names.items()])

    met = sided(mine, "a", "key").hint("merge").join(sided(each, "b", "key"), ["hub", "key"]).where(fits).select(*pair)
    close = rows.where(f"{den} * inside >= {num} * (n + least - inside)")
    left = sided(close.where("other"), "a", F.col("n").alias("na"), F.col("inside").alias("ia"))
    right = sided(close, "b", F.col("n").alias("nb"), F.col("inside").alias("ib"))
    enough = f"{den} * least(ia, ib) >= {num} * (na + nb - least(ia, ib))"
    return met.union(left.hint("merge").join(right, "hub").where(f"{fits} and {enough}").select(*pair)).distinct()


def _resolved(group: DataFrame, links: DataFrame, verified, sets, rounds: int, num: int, den: int) -> DataFrame:
    """All links, with those between members of a group (of one centre) that the centre leaves unconnected."""
    state = group.select(F.col("a").alias("hub"), F.col("b").alias("id"), F.struct("rare", "b").alias("rank"), "flag", F.col("sb").alias("size"), (F.col("a") == F.col("b")).alias("tried"))
    for k in range(rounds + 1):
        label = components(links).withColumnRenamed("node", "id")
        state = state.join(label, "id", "left").select("hub", "id", "rank", "flag", "size", "tried", F.coalesce("component", "id").alias("component"))
        open_ = state.groupBy("hub").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("hub")
        state = written(state.join(open_, "hub"), "state")
        if not state.head(1):
            break
        if k == rounds:
            return links.union(verified(written(_between(state, sets, num, den), "between")))
        by_part = state.groupBy("hub", "component").agg(F.max("tried").alias("done"), F.min(F.when(~F.col("tried"), F.col("rank"))).alias("best"))
        best = by_part.groupBy("hub").agg(F.min(F.when(~F.col("done"), F.col("best"))).alias("x"), F.min("best").alias("y"))
        centre = written(best.select("hub", F.coalesce("x", "y")["b"].alias("centre")).where("centre is not null"), "centre")
        own = state.join(centre, "hub").where("id = centre").select("hub", "centre", F.col("component").alias("own"), F.col("size").alias("around")).distinct()
        fits = f"component <> own and not tried and {den} * least(size, around) >= {num} * greatest(size, around)"
        tries = state.join(own, "hub").where(fits).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        links = written(links.union(verified(tries)), "links")
        state = state.join(centre, "hub").select("hub", "id", "rank", "flag", "size", (F.col("tried") | (F.col("id") == F.col("centre"))).alias("tried"))
    return links
