"""SimHash near-duplicates by anchor-point covering.

Every text gets a fingerprint. Fingerprints within ``threshold`` bits must meet somewhere without
being compared with all others: the codewords of a covering code are the anchors. The fingerprint's bits
are split into sections; in each section the code has covering radius R, so every x lies within R of its
nearest anchor (its home), and every y within t bits of x lies within R + t of that same anchor. So each
fingerprint is sent home, and replicated to every anchor within covering radius plus t, and only homes
are compared with replicas there.

Two fingerprints that differ in at most T bits differ in at most T // s bits in one of s sections, so with
s sections t = T // s suffices. The code of a section is a direct product: of the binary Golay code (23 bits,
R 3, perfect), the Hamming code (7 bits, R 1, perfect) and single bits (R 0). Because a product's distance
adds up by factor, a replica needs only those anchors whose excess over the factor radii sums to at most t.

With two sections of 32 bits and T = 3 there are 2 x 2^18 anchors and 2 x 10.9 replicas on average; with
one section of 64 bits there are 2^36 anchors and about 1,400 replicas. ``sections`` chooses, the links
are the same.

``near_dedup`` links 64-bit fingerprints of three-word shingles. ``keep_one`` drops near copies of texts: it takes five-word
shingles and a similarity of 0.8, where fingerprints of 64 bits differ in about 10. No covering reaches that far,
so texts meet by a second signature that near copies hardly change: 256 bits over distinct words, in eight sections.
Texts of which some section agrees up to one bit are certain to meet at an anchor, others may; where two meet, that is
where an anchor in reach of one is the home of the other, they are compared by 128 bits over distinct shingles. Such
candidates are then verified on their sets of shingles, in ``near_verify``, so nothing goes that is not alike enough.

Anchors with more than ``hot`` members are not compared at once. They come out of the first pass as they are; where the
threshold allows it, their members are dealt again by parts of the fingerprint, of which one at least is equal, and
what is still crowded is compared chunk against chunk, each pair of chunks in a task of its own. Inside a task a few
pivots link a crowd of copies first, and only members of different groups are compared.

Links are never emitted pair by pair: within an anchor each task keeps a union-find and emits one star
per group, at most one row per member. Equal fingerprints are one node from the start.

Defined results: null text is empty text; texts without words have fingerprint zero and are linked like any
other; repeated rows share a fingerprint; an empty table gives an empty result; a null identifier never is
a component's name unless the component has no other; ``keep_one`` leaves of each component the row with the smallest
identifier (null last), then text digest, then columns; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import buffered, discard, keep_owners, materialise
from eventide.llm.components import connected_components
from eventide.llm.near_verify import verified_links

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


# ---- fingerprints ----------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = 3, seed: int = 42, block: int = 65536) -> int:
    """Unsigned 64-bit SimHash of one text over all its word shingles, repeats included."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; splits at 09-0D and 20
    if not tokens:
        return 0
    h = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return h(b" ".join(tokens), seed)
    n = len(tokens) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, block):
        part = [tokens[at + i : min(n, at + block) + i] for i in range(words)]
        hashes = np.fromiter((h(s, seed) for s in map(b" ".join, zip(*part))), dtype=np.uint64)
        ones += _bit_counts(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each bit: per byte lane a 256-bin histogram times the bits of its bins."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(lanes) < 512:
        return np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bins = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return np.concatenate([np.bincount(lanes[:, i], minlength=256) @ bins for i in range(8)])


def _print_batches(words: int, seed: int):
    def run(batches):
        def rows():
            for b in batches:
                texts = b.column("text")
                for k, ident in enumerate(b.column("doc_id").to_pylist()):
                    fp = fingerprint(texts[k].as_py(), words, seed)
                    yield ident, fp - (1 << 64) if fp >> 63 else fp

        yield from buffered(rows(), _PRINTS)

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_print_batches(words, seed), "doc_id long, fp long")


# ---- anchors ---------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(codewords, home index of each 23-bit word) of the binary Golay code, from its generator polynomial."""
    g = 0b101011100011
    words = np.zeros(1, dtype=np.int64)
    for i in range(12):
        words = np.concatenate([words, words ^ (g << i)])
    return words, _homes(words, 23, 3)


@lru_cache(maxsize=1)
def _hamming() -> tuple[np.ndarray, np.ndarray]:
    words = np.array([x for x in range(128) if not _syndrome(x)], dtype=np.int64)
    return words, _homes(words, 7, 1)


def _syndrome(x: int) -> int:
    s = 0
    for i in range(7):
        if x >> i & 1:
            s ^= i + 1
    return s


def _homes(words: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """Nearest codeword's index for every word; both codes are perfect, so it is the only one within ``radius``."""
    home = np.full(1 << bits, -1, dtype=np.int32)
    index = np.arange(len(words), dtype=np.int32)
    for e in _patterns(bits, radius):
        home[words ^ e] = index
    assert (home >= 0).all()
    return home


def _patterns(bits: int, weight: int) -> np.ndarray:
    """All error patterns of at most ``weight`` bits."""
    masks = np.zeros(1, dtype=np.int64)
    level = masks
    for _ in range(weight):
        level = np.unique((level[:, None] | (1 << np.arange(bits, dtype=np.int64))).ravel())
        masks = np.union1d(masks, level)
    return masks


@lru_cache(maxsize=8)
def _factors(bits: int) -> tuple[tuple[str, int], ...]:
    """Code of a section as a product: Golay for each 23 bits, then Hamming for each 7, then single bits."""
    out = []
    for kind, width in (("golay", 23), ("hamming", 7), ("bit", 1)):
        while bits >= width:
            out.append((kind, width))
            bits -= width
    return tuple(out)


def _near(kind: str, x: np.ndarray, excess: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(row, anchor, excess over the radius) of every anchor whose excess is at most ``excess``; the home comes first."""
    rows = np.arange(len(x))
    if kind == "bit":
        found = [(rows, x, 0)]
        return found + [(rows, x ^ 1, 1)] if excess else found
    words, home = _golay() if kind == "golay" else _hamming()
    bits, radius = (23, 3) if kind == "golay" else (7, 1)
    found = [(rows, home[x].astype(np.int64), 0)]
    for e in range(1, excess + 1):
        hit_rows, hit_words = [], []
        if kind == "hamming":
            far = np.bitwise_count((x[:, None] ^ words[None, :]).astype(np.uint64)) == radius + e
            r, w = np.nonzero(far)
            hit_rows.append(r)
            hit_words.append(w)
        else:
            for at in range(0, len(x), 512):
                far = np.bitwise_count((x[at : at + 512, None] ^ words[None, :]).astype(np.uint32)) == radius + e
                r, w = np.nonzero(far)
                hit_rows.append(r + at)
                hit_words.append(w)
        found.append((np.concatenate(hit_rows), np.concatenate(hit_words).astype(np.int64), e))
    return found


def _width(kind: str) -> int:
    return {"golay": 12, "hamming": 4, "bit": 1}[kind]


def anchors(values: np.ndarray, bits: int, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor number, is home) for each value and each anchor within reach of it."""
    row, code, spent = np.arange(len(values)), np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
    low = 0
    for kind, width in _factors(bits):
        part = (values >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        low += width
        options = _near(kind, part, excess)
        next_rows, next_codes, next_spent = [], [], []
        for who, anchor, e in options:
            order = np.argsort(who, kind="stable")
            who, anchor = who[order], anchor[order]
            first = np.searchsorted(who, np.arange(len(values)))
            count = np.searchsorted(who, np.arange(len(values)), side="right") - first
            ok = np.nonzero(spent + e <= excess)[0]
            times = count[row[ok]]
            src = np.repeat(ok, times)
            within = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
            next_rows.append(row[src])
            next_codes.append(code[src] << _width(kind) | anchor[first[row[src]] + within])
            next_spent.append(spent[src] + e)
        row, code, spent = map(np.concatenate, (next_rows, next_codes, next_spent))
    return row, code, spent == 0


# ---- candidates ------------------------------------------------------------------------------------


def _section_bits(sections: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each section of a 64-bit word."""
    edges = [64 * i // sections for i in range(sections + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _replicate(words: int, checks: int, sections: int, excess: int, block: int = 2048):
    """(node, words.., checks..) -> (anchor, node, checks.., home): an anchor's number holds word, section and codeword."""

    def run(batches):
        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(1 + words + checks)]
            for at in range(0, b.num_rows, block):
                node, *rest = (c[at : at + block] for c in columns)
                for w in range(words):
                    word = rest[w].view(np.uint64)
                    for s, (low, width) in enumerate(_section_bits(sections)):
                        values = word >> np.uint64(low)
                        if width < 64:
                            values = values & np.uint64((1 << width) - 1)
                        row, code, home = anchors(values, width, excess)
                        code |= (w * sections + s) << 48
                        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(node[row]), *[pa.array(c[row]) for c in rest[words:]], pa.array(home)], names=["anchor", "node", *[f"c{i}" for i in range(checks)], "home"])

    return run


def _link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of many pairs at once: pointers move to the smaller root until nothing changes."""
    while len(a):
        ra, rb = parent[a], parent[b]
        far = ra != rb
        if not far.any():
            return
        a, b, ra, rb = a[far], b[far], ra[far], rb[far]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent[:] = above


def _stars(node: np.ndarray, bits: list[np.ndarray], home: np.ndarray, threshold: int, tile: int = 256, pivots: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Star rows, members and their roots, that connect every home with all members within ``threshold`` bits of it.

    Tiles are of bounded size. In a crowd a few homes are pivots first: whoever is near one joins its group, and
    members of one group need no further comparison with each other.
    """
    homes = np.nonzero(home)[0]
    if len(node) < 2 or not len(homes):
        return node[:0], node[:0]
    parent = np.arange(len(node))
    words = [c.view(np.uint64) for c in bits]

    def compare(mine: np.ndarray, others: np.ndarray) -> None:
        for at in range(0, len(mine), tile):
            a = mine[at : at + tile]
            for to in range(0, len(others), 8 * tile):
                b = others[to : to + 8 * tile]
                far = reduce(np.add, (np.bitwise_count(w[a][:, None] ^ w[None, b]) for w in words))
                i, j = np.nonzero(far <= threshold)
                _link(parent, a[i], b[j])

    everyone = np.arange(len(node))
    if len(homes) > 4 * tile:
        waiting = homes
        for _ in range(pivots):
            if not len(waiting):
                break
            compare(waiting[:1], everyone)
            waiting = waiting[parent[waiting] != parent[waiting[0]]]
    group = parent[homes]
    labels, sizes = np.unique(group, return_counts=True)
    crowds = labels[sizes > tile]
    for label in crowds:
        compare(homes[group == label], everyone[parent != parent[label]])
    compare(homes[~np.isin(group, crowds)], everyone)
    moved = np.nonzero(parent != everyone)[0]
    return node[moved], node[parent[moved]]


def _compare(keys: int, checks: int, threshold: int, hot: int | None):
    """Members arrive sorted by key. Keys of at most ``hot`` members give stars (u, v); members of others pass through with u null."""

    schema = _found(checks)

    def batch(n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def links(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*parts)]
        member, root = _stars(columns[0], columns[1:-1], columns[-1], threshold)
        for at in range(0, len(member), _EMIT):
            some = slice(at, at + _EMIT)
            yield batch(len(member[some]), {"u": pa.array(member[some]), "v": pa.array(root[some])})

    def through(anchor: int, part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Members of a crowd, as they came, in slices of columns."""
        names = ["node", *[f"c{i}" for i in range(checks)], "home"]
        for at in range(0, len(part[0]), _EMIT):
            some = [pa.array(c[at : at + _EMIT]) for c in part]
            yield batch(len(some[0]), dict(zip(names, some)) | {"anchor": pa.array(np.full(len(some[0]), anchor, dtype=np.int64))})

    def run(batches):
        last, parts, held = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            ks = [b.column(i).to_numpy() for i in range(keys)]
            data = [b.column(keys + i).to_numpy(zero_copy_only=False) for i in range(checks + 2)]
            cut = np.ones(b.num_rows, dtype=bool)
            cut[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in ks])
            starts = np.nonzero(cut)[0]
            for a, z in zip(starts, np.append(starts[1:], b.num_rows)):
                key = tuple(k[a].item() for k in ks)
                if key != last:
                    if parts:
                        yield from links(parts)
                    last, parts, held = key, [], 0
                parts.append([c[a:z].copy() for c in data])  # a copy, or a few rows would keep their whole batch
                held += int(z - a)
                if hot is not None and held > hot:
                    for part in parts:
                        yield from through(key[0], part)
                    parts = []
        if parts:
            yield from links(parts)

    return run


#: Rows of a batch that goes back to Spark.
_EMIT = 4096


def _found(checks: int) -> pa.Schema:
    return pa.schema([("u", pa.int64()), ("v", pa.int64()), ("anchor", pa.int64()), ("node", pa.int64()), *[(f"c{i}", pa.int64()) for i in range(checks)], ("home", pa.bool_())])


def near_links(points: DataFrame, words: list[str], checks: list[str], threshold: int, sections: int = 2, excess: int | None = None, refine: bool = True, hot: int = 16_384, per_task: int = 8192) -> DataFrame:
    """(u, v): star rows over ``node`` of ``points``.

    They connect every two nodes whose ``checks`` differ in at most ``threshold`` bits and of whose ``words`` some section
    meets at an anchor, which is certain up to ``excess`` bits (by default so many that, where words and checks are the
    same, no pair is missed).
    ``refine`` deals crowded anchors again by equal parts of the first check, for small thresholds over one word.
    """
    excess = threshold // sections if excess is None else excess
    if excess > 3:
        raise ValueError("at most 3 bits of excess in a section")
    n = len(checks)
    held = [f"c{i}" for i in range(n)]
    body = ", ".join([f"{c} long" for c in held])
    signed = [F.col(c).cast("long").alias(f"w{i}") for i, c in enumerate(words)] + [F.col(c).cast("long").alias(h) for c, h in zip(checks, held)]
    # a node is a few words but fans out to many replicas: tasks are cut by rows, not by bytes
    dealt = points.select("node", *signed).repartition(max(1, -(-points.count() // per_task)), "node")
    replicas = dealt.mapInArrow(_replicate(len(words), n, sections, excess), f"anchor long, node long, {body}, home boolean")

    def compared(rows: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
        placed = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", *held, "home")
        return materialise(placed.mapInArrow(_compare(len(keys), n, threshold, limit), f"u long, v long, anchor long, node long, {body}, home boolean"), "stars")

    found = compared(replicas, ["anchor"], hot)
    stars, crowd = found.where("u IS NOT NULL").select("u", "v"), found.where("u IS NULL").drop("u", "v")
    if refine and not crowd.isEmpty():
        # within the threshold at least one of threshold + 1 parts is equal
        parts = [F.shiftrightunsigned("c0", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in _cuts(threshold + 1)]
        found = compared(crowd.select("*", F.posexplode(F.array(*parts)).alias("part", "bits")), ["anchor", "part", "bits"], hot)
        stars, crowd = stars.union(found.where("u IS NOT NULL").select("u", "v")), found.where("u IS NULL").drop("u", "v").distinct()
    if not crowd.isEmpty():
        sizes = crowd.groupBy(F.col("anchor").alias("s_anchor")).agg(F.ceil(F.count(F.lit(1)) * 2 / hot).alias("chunks"))
        numbered = crowd.join(sizes, F.col("anchor") == F.col("s_anchor")).withColumn("mine", F.pmod(F.xxhash64("node"), "chunks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        as_home = numbered.where("home").withColumn("row", F.col("mine")).withColumn("column", other)
        as_member = numbered.withColumn("column", F.col("mine")).withColumn("row", other).where("NOT home OR row <> column").withColumn("home", F.lit(False))
        found = compared(as_home.unionByName(as_member), ["anchor", "row", "column"], None)
        stars = stars.union(found.select("u", "v"))
    return stars


def _cuts(parts: int) -> list[tuple[int, int]]:
    edges = [64 * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``component``, the smallest node reachable."""
    member = materialise(connected_components(links, "u", "v").toDF("m_node", "m_component"), "members")
    return nodes.join(member, F.col("node") == F.col("m_node"), "left").withColumn("component", F.coalesce("m_component", "node")).drop("m_node", "m_component")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 3, sections: int = 2, seed: int = 42, hot: int = 16_384) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    prints = materialise(fingerprints(df, id_col, text_col, words, seed), "prints")
    nodes = materialise(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least_id")), "nodes")
    named = materialise(_named(nodes, near_links(nodes, ["node"], ["node"], threshold, sections, hot=hot)), "named")
    least = materialise(named.groupBy(F.col("component").alias("l_component")).agg(F.min("least_id").alias("component_id")), "names")
    classes = materialise(named.join(least, F.col("component") == F.col("l_component")).select("node", "component_id"), "classes")
    discard(nodes, named, least)
    return prints.join(classes, F.col("fp") == F.col("node")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# ---- near copies of texts --------------------------------------------------------------------------

_WORDS, _CHECKS = ["w0", "w1", "w2", "w3"], ["c0", "c1"]
_SETS = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("copies", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_SIGNED = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("shape", pa.binary()), *[(c, pa.int64()) for c in _WORDS + _CHECKS]])
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _majority(items: set[bytes], seeds: tuple[int, ...]) -> np.ndarray:
    """128 bits for each seed, as signed 64-bit words: those set in over half of the items' hashes."""
    import xxhash

    out = []
    for seed in seeds:
        lanes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, seed) for x in items]), dtype="<u8")
        out.append(np.packbits(np.concatenate([_bit_counts(lanes[i::2]) for i in range(2)]) * 2 > len(items), bitorder="little"))
    return np.concatenate(out).view("<i8")


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; case and punctuation do not count."""
    import xxhash

    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, _shingles(_tokens(text), shingle)), dtype=np.uint64)).view(np.int64)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _PUNCTUATION).split()


def _shingles(tokens: list[bytes], shingle: int) -> set[bytes]:
    if not tokens:
        return set()
    return set(map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))) or {b" ".join(tokens)}


def signature(text: str | None, shingle: int = 5) -> tuple[list[int], bytes]:
    """Four words over the distinct words of a text, two over its distinct shingles, and a digest of the set of shingles."""
    import xxhash

    tokens = _tokens(text)
    if not tokens:
        return [0] * 6, b""
    shingles = _shingles(tokens, shingle)
    shape = xxhash.xxh3_128_digest(b"\n".join(sorted(shingles)))
    return [*_majority(set(tokens), (1, 2)).tolist(), *_majority(shingles, (3,)).tolist()], shape


def bits_apart(similarity: float, bits: int = 128) -> int:
    """Bits by which fingerprints of two shingle sets of this Jaccard similarity differ at most, but for one pair in forty: the expected number and two standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def _signature_batches(shingle: int):
    def run(batches):
        def rows():
            for b in batches:
                texts, digests = b.column("text"), b.column("digest").to_pylist()
                for k, ident in enumerate(b.column("id").to_pylist()):
                    words, shape = signature(texts[k].as_py(), shingle)
                    yield ident, digests[k], shape, *words

        yield from buffered(rows(), _SIGNED)

    return run


def _set_batches(shingle: int):
    def run(batches):
        def rows():
            for b in batches:
                texts = b.column("text")
                for k, held in enumerate(zip(*(b.column(c).to_pylist() for c in ("node", "component", "copies")))):
                    yield *held, shingle_hashes(texts[k].as_py(), shingle)

        yield from buffered(rows(), _SETS, size=512)

    return run


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, hot: int = 16_384) -> DataFrame:
    """One row of each group of near copies, columns as they came.

    Groups are the components of links between texts whose sets of shingles are at least ``similarity`` alike (Jaccard), which is verified; candidates
    are texts that meet at an anchor and differ in at most ``bits_apart(similarity)`` bits.
    """
    ident, digest = df[id_col].cast("long"), F.unhex(F.sha2(F.coalesce(df[text_col].cast("string"), F.lit("")), 256))
    source = df.select(ident.alias("id"), df[text_col].cast("string").alias("text"), digest.alias("digest"))
    signed = materialise(source.mapInArrow(_signature_batches(shingle), "id long, digest binary, shape binary, " + ", ".join(f"{c} long" for c in _WORDS + _CHECKS)), "prints")
    texts = signed.groupBy("id", "digest", "shape", *_WORDS, *_CHECKS).agg(F.count(F.lit(1)).alias("rows"))
    owner = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "rows")
    # texts with the same set of shingles are one node
    nodes = texts.groupBy("shape", *_WORDS, *_CHECKS).agg(F.min(owner).alias("owner")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes.drop("shape"), "nodes")
    threshold = bits_apart(similarity)
    met = connected_components(near_links(nodes, _WORDS, _CHECKS, threshold, excess=1, refine=False, hot=hot), "u", "v").toDF("node", "component")
    members = materialise(met.join(nodes.select("node", *_CHECKS, "owner"), "node"), "members")
    wanted = members.select("node", "component", F.col("owner.rows").alias("copies"), F.col("owner.id").alias("w_id"), F.col("owner.digest").alias("w_digest"))
    of_members = source.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))).select("node", "component", "copies", "text")
    read = materialise(of_members.mapInArrow(_set_batches(shingle), "node long, component long, copies long, shingles array<long>"), "sets")
    sets = read.where("copies = 1").unionAll(read.where("copies > 1").dropDuplicates(["node"])).drop("copies")  # repeated rows have one text
    links = materialise(verified_links(members.drop("owner"), sets, similarity, threshold), "links")
    owners = _named(nodes.select("node", "owner"), links).groupBy("component").agg(F.min("owner").alias("owner"))
    owners = materialise(owners.select("owner.id", "owner.digest", "owner.rows"), "owners")
    discard(signed, nodes, members, read, links)
    return keep_owners(df, [ident, digest], owners)
