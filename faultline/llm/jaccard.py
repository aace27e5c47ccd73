"""Exact Jaccard join of word n-gram sets, by candidate families and token-group matrices.

A set is cut into classes by token hash. Two sets of similar sizes that differ in at most D
tokens agree in all but D classes, so with more classes than that they share a whole class,
whatever is frequent in the corpus. Documents that share a class form families. Inside a family,
similar documents (by size) are partitioned into groups of up to 64; a matrix holds for each
token the members of a group that have it, its non-zero rows being the group's token union. A
query's overlap with the union bounds its overlap with every member; only groups whose bound reaches
the needed overlap are opened, and opening counts all members at once. Nothing is lost: every
step is a bound, and links are decided by exact set sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.graph import components
from faultline.llm.skew import attach, fits, held, marked_rows, numbered, numbered_in_place, without_rows
from faultline.llm.warc import file_system
from faultline.llm.words import Sums, TextSlice, find_words, grams, lean, mix, text_slices
from faultline.session import new_folder

GROUP = 64  # members of a group: bits of a matrix row
SENT_SLICE = 1 << 20  # bytes of text within which a signature is sent once
FREQUENT = 1 << 16  # shingles that are told to every task as frequent: 512 kB
CHUNK = 512  # sets of a family that meet in one task with as many others; a larger family is cut by size and hash
CHUNK_UNITS, UNIT_TASKS = 4, 4096  # pairs of chunks for a task, until there are so many tasks
ROW_GROUP = 1 << 20  # bytes of sets in a file that are read at once


class Rule:
    """A similarity threshold of ``percent`` and the size classes that follow from it."""

    def __init__(self, percent: int = 85):
        self.percent = percent
        # Below this size only equal sets are similar enough.
        self.least = -(-percent // (100 - percent))
        self.low, self.high = [self.least], []
        while self.low[-1] < 1 << 31:
            self.high.append(self.low[-1] * 100 // percent)
            self.low.append(self.high[-1] + 1)
        self.high.append(self.low[-1] * 100 // percent)

    def differing(self, band: int) -> int:
        """Tokens in which a set of ``band`` and one of ``band`` or the next can differ and be similar."""
        return (self.high[band] + self.high[band + 1]) * (100 - self.percent) // (100 + self.percent)

    def needed(self, a, b):
        """Common tokens that sets of sizes a and b need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1


def shingle_sets(part: TextSlice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice's texts, ascending per row, and the bounds of the rows.

    A text of fewer than ``n`` words, but at least one, is one shingle.
    """
    rows = len(part.offsets) - 1
    words = find_words(part)
    hashes = Sums(part.data, lower=True).hashes(words.starts, words.ends)
    counts = np.diff(words.bounds)
    found = grams(hashes, n)
    inside = words.rows[: len(found)] == words.rows[n - 1 :] if len(found) else np.zeros(0, bool)
    tokens, owners = [found[inside]], [words.rows[: len(found)][inside]]
    for length in range(1, n):
        short = np.flatnonzero(counts == length)
        if len(short):
            first = words.bounds[short]
            whole = hashes[first]
            for k in range(1, length):
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + hashes[first + k])
            tokens.append(mix(whole + np.uint64(length)))
            owners.append(short)
    token, owner = np.concatenate(tokens), np.concatenate(owners)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    fresh = np.ones(len(token), dtype=bool)
    fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[fresh], owner[fresh]
    return token, np.searchsorted(owner, np.arange(rows + 1))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def set_keys(token: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit keys: equal sets have equal keys."""
    one = mix(row_sums(mix(token), bounds))
    two = mix(row_sums(mix(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds))
    both = np.column_stack([one, two])
    return [r.tobytes() for r in both]


def keyed(n: int):
    """mapInArrow: (doc_id, text) to (doc_id, n_shingles, set_key)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for part in text_slices(batch.column(1)):
                token, bounds = shingle_sets(part, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.first, len(bounds) - 1),
                        pa.array(np.diff(bounds)),
                        pa.array(set_keys(token, bounds), pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key"],
                )

    return run


def count_frequent(n: int):
    """mapInArrow: (doc_id, text) to (token, texts): shingles that two or more texts of a slice have."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                token, counts = np.unique(shingle_sets(part, n)[0], return_counts=True)
                often = counts > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[often].view(np.int64)), pa.array(counts[often])], names=["token", "texts"]
                )

    return run


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """The shingles that most texts share, ascending; at most FREQUENT of them.

    They only guide which classes a document leaves out, so no link depends on the list.
    """
    found = (
        docs.mapInArrow(count_frequent(n), "token long, texts long")
        .groupBy("token")
        .agg(F.sum("texts").alias("texts"))
        .orderBy(F.desc("texts"), "token")
        .limit(FREQUENT)
    )
    return np.sort(np.array([r.token for r in found.select("token").collect()], dtype=np.int64).view(np.uint64))


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted list."""
    if not len(ascending):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def band_signatures(token, bounds, rows, band, rule: Rule, frequent) -> tuple[np.ndarray, np.ndarray]:
    """Class signatures of the given rows in one instance each (``band`` per row): (signature, row).

    With D differing tokens there are D + 1 + 2h classes, and every document leaves out the
    h ones with the fewest tokens that are not frequent; of the 2h + 1 classes in which a similar pair agrees at least one is kept by both.
    An empty class that can't be left out stands for the document's prefix tokens: similar sets share one.
    """
    differing = np.array([rule.differing(b) for b in range(int(band.max()) + 1)])[band]
    spare = (differing + 1) // 6
    classes = differing + 1 + 2 * spare
    base = np.concatenate([[0], np.cumsum(classes)])
    sizes = bounds[rows + 1] - bounds[rows]
    at = np.repeat(np.arange(len(rows)), sizes)
    flat = np.repeat(bounds[rows], sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    values = token[flat]
    # Tokens ascend, and so do their classes: the upper half of the hash, scaled.
    slot = base[at] + ((values >> np.uint64(32)) * classes[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(slot, minlength=base[-1])
    content = row_sums(mix(values), np.concatenate([[0], np.cumsum(count)]))
    owner = np.repeat(np.arange(len(rows)), classes)
    number = np.arange(base[-1]) - base[owner]
    telling = np.bincount(slot[~frequent[flat]], minlength=base[-1])
    order = np.lexsort((count, telling, owner))
    place = np.arange(base[-1]) - base[owner]  # owners are in blocks, before and after sorting
    kept = order[place >= spare[owner]]
    full = kept[count[kept] > 0]
    tag = mix(
        (band[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1)
    )
    signature = mix(content[full] ^ tag[full])
    rest = kept[count[kept] == 0]
    extra, extra_rows = [], []
    for where in rest:
        row = owner[where]
        first, size = bounds[rows[row]], sizes[row]
        prefix = size - -(-rule.percent * size // 100) + 1
        extra.append(mix(token[first : first + prefix] ^ ~tag[where]))
        extra_rows.append(np.full(prefix, row))
    if extra:
        return (
            np.concatenate([signature, *extra]),
            rows[np.concatenate([owner[full], *extra_rows])],
        )
    return signature, rows[owner[full]]


def signatures(
    token: np.ndarray, bounds: np.ndarray, rule: Rule, frequent: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """All class signatures of a slice: (signature, row); ``frequent`` is an ascending list of tokens."""
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes >= rule.least)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = rule.bands(sizes[rows])
    known = among(token, frequent)
    parts = [band_signatures(token, bounds, rows, own, rule, known)]
    upper = own > 0
    if upper.any():
        parts.append(band_signatures(token, bounds, rows[upper], own[upper] - 1, rule, known))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


SIGNED = "signature long, doc_id long, head long"


def signed(n: int, rule: Rule, frequent: np.ndarray):
    """mapInArrow: (doc_id, text) to (signature, doc_id, head).

    Within a slice a signature is sent once, by its first document; others that have it
    come back as rows without a signature that name that document as their head. So a signature
    that a third of all documents have is one row per slice in the shuffle.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for part in text_slices(batch.column(1), SENT_SLICE):
                token, bounds = shingle_sets(part, n)
                signature, row = signatures(token, bounds, rule, frequent)
                doc = ids[part.first + row]
                order = np.lexsort((doc, signature))
                signature, doc = signature[order], doc[order]
                first = np.ones(len(signature), dtype=bool)
                first[1:] = signature[1:] != signature[:-1]
                head = doc[first][np.cumsum(first) - 1] if len(doc) else doc
                local = np.unique(np.column_stack([doc, head])[~first & (doc != head)], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays(
                            [pa.array(signature[first].view(np.int64)), pa.nulls(len(local), pa.int64())]
                        ),
                        pa.array(np.concatenate([doc[first], local[:, 0]])),
                        pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(local[:, 1])]),
                    ],
                    names=["signature", "doc_id", "head"],
                )

    return run


@lean
def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over SIGNED rows sorted by signature: links (a, b) of each document to its signature's first one."""
    last_signature = last_head = None
    for batch in batches:
        known = batch.filter(batch.column(2).is_valid())
        batch = batch.filter(batch.column(0).is_valid())
        signature = batch.column(0).to_numpy(zero_copy_only=False)
        doc = batch.column(1).to_numpy(zero_copy_only=False)
        head = np.zeros(0, dtype=np.int64)
        if len(doc):
            first = np.ones(len(doc), dtype=bool)
            first[1:] = signature[1:] != signature[:-1]
            head = doc[first][np.cumsum(first) - 1]
            if last_signature is not None and signature[0] == last_signature:
                head[: int(np.argmax(first[1:])) + 1 if first[1:].any() else len(head)] = last_head
            last_signature, last_head = signature[-1], head[-1]
        pairs = np.unique(np.column_stack([doc, head])[doc != head], axis=0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(pairs[:, 0]), known.column(1).cast(pa.int64())]),
                pa.concat_arrays([pa.array(pairs[:, 1]), known.column(2).cast(pa.int64())]),
            ],
            names=["a", "b"],
        )


def packed_sets(n: int):
    """mapInArrow: (doc_id, unit, text) to the same with the set as bytes in place of the text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(2)):
                token, bounds = shingle_sets(part, n)
                sets = [token[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                head = batch.slice(part.first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [*head.columns[:2], pa.array(sets, pa.binary())], names=["doc_id", "unit", "tokens"]
                )

    return run


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def link_sets(sets: list[np.ndarray], rule: Rule, chunk: np.ndarray | None = None) -> Union:
    """Join all similar sets of a list; with ``chunk``, only those of different chunks need be compared.

    The token-group matrix of each group is one array over the list's tokens, a bit per member.
    """
    n = len(sets)
    union = Union(n)
    sizes = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    width = int(local.max()) + 1 if len(local) else 0
    order = np.argsort(sizes, kind="stable")
    for start in range(0, n, GROUP):
        group = order[start : start + GROUP]
        matrix = np.zeros(width, dtype=np.uint64)
        for bit, member in enumerate(group):
            matrix[local[cut[member] : cut[member + 1]]] |= np.uint64(1 << bit)
        smallest, largest = sizes[group[0]], sizes[group[-1]]
        # Queries stand at or after the group's start in order of size, up to the largest partner's.
        for query in order[start:]:
            size = sizes[query]
            if size * rule.percent > largest * 100:
                break
            if chunk is not None and (chunk[group] == chunk[query]).all():
                continue
            own = union.root(query)
            if all(union.root(m) == own for m in group):
                continue
            bits = matrix[local[cut[query] : cut[query + 1]]]
            bound = np.count_nonzero(bits)
            if bound < rule.needed(size, max(smallest, -(-size * rule.percent // 100))):
                continue
            common = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0)[: len(group)]
            for member in group[common * 100 >= rule.percent * (size + sizes[group] - common)]:
                union.join(int(query), int(member))
    return union


def links_of_sets(ids: np.ndarray, packed: list[bytes], chunk: np.ndarray | None, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b): each document that is joined with others, and the first of them."""
    order = np.argsort(ids, kind="stable")
    sets = [np.frombuffer(packed[i], dtype=np.uint64) for i in order]
    union = link_sets(sets, rule, None if chunk is None else chunk[order])
    root = np.array([union.root(i) for i in range(len(sets))], dtype=np.int64)
    joined = root != np.arange(len(sets))
    ids = ids[order]
    return ids[joined], ids[root[joined]]


def links_of_unit(rule: Rule):
    """applyInArrow over the sets of a family: one link per document to the first one it is joined with."""

    def run(table: pa.Table) -> pa.Table:
        a, b = links_of_sets(table.column("doc_id").to_numpy(), table.column("tokens").to_pylist(), None, rule)
        return pa.table({"a": a, "b": b})

    return run


def read_chunk(spans: list[dict]) -> tuple[np.ndarray, list[bytes]]:
    """The ids and sets of a chunk, from the row groups of files that hold it: (file, first, n_sets) each."""
    ids, sets = [np.zeros(0, dtype=np.int64)], []
    for span in spans:
        system, path = file_system(span["file"])
        with system.open_input_file(path) as stream:
            file = pq.ParquetFile(stream)
            sizes = [file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            first, stop = span["first"], span["first"] + span["n_sets"]
            groups = [g for g in range(len(sizes)) if starts[g] < stop and starts[g + 1] > first]
            found = file.read_row_groups(groups, ["doc_id", "tokens"], use_threads=False)
            found = found.slice(first - int(starts[groups[0]]), span["n_sets"])
            ids.append(found.column("doc_id").to_numpy())
            sets += found.column("tokens").to_pylist()
    return np.concatenate(ids), sets


def links_of_chunks(rule: Rule):
    """mapInArrow: (low, high), the spans of two chunks that meet, or twice of one, to links (a, b)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                ids, sets = read_chunk(unit["low"])
                chunk = None
                if unit["high"] != unit["low"]:
                    others, more = read_chunk(unit["high"])
                    chunk = np.repeat([0, 1], [len(ids), len(others)])
                    ids, sets = np.concatenate([ids, others]), sets + more
                a, b = links_of_sets(ids, sets, chunk, rule)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def members_with_texts(texts: DataFrame, dealt: DataFrame, label: str) -> DataFrame:
    """(doc_id, unit, text) of the documents in ``dealt`` (_gone, unit).

    Beyond what can be broadcast, only the texts of these documents are shuffled.
    """
    dealt = held(dealt, label)
    if fits(dealt):
        dealt = F.broadcast(dealt)
    else:
        marked = marked_rows(texts, dealt, f"{label}-bits", "doc_id")
        texts = texts if marked is None else marked.filter("_marked")
    return texts.join(dealt, F.col("doc_id") == F.col("_gone")).select("doc_id", "unit", "text")


PACKED = "doc_id long, unit long, tokens binary"


def links_within(texts: DataFrame, members: DataFrame, n: int, rule: Rule) -> DataFrame:
    """Links (a, b) of the sets of small families, each whole in one task; ``members`` has (doc_id, family)."""
    dealt = members.select(F.col("doc_id").alias("_gone"), F.col("family").alias("unit"))
    sets = members_with_texts(texts, dealt, "family-members").mapInArrow(packed_sets(n), PACKED)
    return sets.groupBy("unit").applyInArrow(links_of_unit(rule), "a long, b long")


def links_across(texts: DataFrame, members: DataFrame, n: int, rule: Rule) -> DataFrame:
    """Links (a, b) of the sets of large families; ``members`` has (doc_id, family, band).

    A family is cut by band, where similar sets are in one band or in neighbouring ones, and a band into chunks by hash. Each set is
    written once, beside the others of its chunk, and the tasks that compare chunks read them there, however many chunks a chunk meets.
    """
    spark = texts.sparkSession
    keys = ["family", "band"]
    cells = held(
        members.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("parts")), "family-bands"
    )
    chunk = F.xxhash64(*keys, "part")
    dealt = (
        members.join(F.broadcast(cells) if fits(cells) else cells, keys)
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .select(F.col("doc_id").alias("_gone"), chunk.alias("unit"))
    )
    sets = members_with_texts(texts, dealt, "chunk-members").mapInArrow(packed_sets(n), PACKED)
    folder = new_folder(spark, "chunks")
    sets.repartition("unit").sortWithinPartitions("unit").write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    spans = (
        spark.read.schema(sets.schema)
        .parquet(folder)
        .groupBy("unit", F.col("_metadata.file_path").alias("file"))
        .agg(F.min("_metadata.row_index").alias("first"), F.count(F.lit(1)).alias("n_sets"))
        .groupBy("unit")
        .agg(F.sort_array(F.collect_list(F.struct("file", "first", "n_sets"))).alias("spans"))
    )
    every = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = held(every.withColumn("unit", chunk).join(spans, "unit").select(*keys, "part", "spans"), "chunk-spans")
    low = every.select(*keys, F.col("part").alias("low_part"), F.col("spans").alias("low"))
    high = every.select(
        "family",
        F.col("band").alias("high_band"),
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"),
        "part",
        F.col("spans").alias("high"),
    )
    units = held(
        low.join(high, keys)
        .filter((F.col("high_band") > F.col("band")) | (F.col("part") >= F.col("low_part")))
        .select("low", "high"),
        "chunk-pairs",
    )
    tasks = min(UNIT_TASKS, -(-units.count() // CHUNK_UNITS))
    return units.repartition(max(1, tasks)).mapInArrow(links_of_chunks(rule), "a long, b long")


def families(docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """(node, root): documents that share a class signature, directly or over others."""
    marks = docs.mapInArrow(signed(n, rule, frequent_shingles(docs, n)), SIGNED)
    # Rows that have their head already only pass through, spread by document.
    home = F.coalesce("signature", F.xxhash64("doc_id"))
    links = (
        marks.repartition(home).sortWithinPartitions("signature", "doc_id").mapInArrow(heads, "a long, b long")
    )
    return components(links)


def components_of_texts(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of held (doc_id, text) with ids that are never missing or repeated."""
    rule = Rule(percent)
    narrow = held(
        texts.mapInArrow(keyed(n), "doc_id long, n_shingles long, set_key binary"), "sets"
    )
    equal = held(
        narrow.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("twin"), F.max("n_shingles").alias("size")),
        "equal-sets",
    )
    # Families are found among all documents, and compared by one document for each set.
    family = families(texts, n, rule)
    singles = equal.select(F.col("twin").alias("doc_id"), "size")
    bands = F.array_position(F.transform(F.array(*map(F.lit, rule.high)), lambda most: most >= F.col("size")), True)
    members = held(
        family.join(singles, F.col("node") == F.col("doc_id")).select(
            "doc_id", F.col("root").alias("family"), (bands - 1).cast("int").alias("band")
        ),
        "members",
    )
    counted = held(
        members.groupBy("family").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "families"
    )
    sized = held(
        attach(members, counted, "family", "doc_id", ["group_size"]).filter("group_size is not null"), "sized-members"
    )
    links = links_within(texts, sized.filter(F.col("group_size") <= CHUNK), n, rule)
    large = sized.filter(F.col("group_size") > CHUNK)
    if not large.isEmpty():
        links = links.unionByName(links_across(texts, large, n, rule))
    joined = components(links)
    named = equal.join(joined, F.col("twin") == F.col("node"), "left").select(
        "set_key", "group_size", F.coalesce("root", "twin").alias("component_id")
    )
    return attach(narrow, held(named, "named-sets"), "set_key", "doc_id", ["component_id"]).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )



def similar_groups(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs without white space, A-Z in lower case; a set has the distinct shingles
    of ``n`` words, or the whole text as one if it is shorter. Sets link when 100 times their intersection is
    at least ``percent`` times their union; a component is named after its smallest id, one without any
    id has none. Null and empty texts, and texts of white space, have no set and stand alone.
    Rows are told apart by a stored number of their own, so repeated and missing ids link like
    any other. Tokens are 64-bit hashes; equal sets are told by 128 bits.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "jaccard-texts", compression="zstd")
    found = components_of_texts(rows.select(F.col("_row").alias("doc_id"), "text"), n, percent).select(
        F.col("doc_id").alias("_found"), "n_shingles", "component_id"
    )
    members = held(
        found.join(rows.select("_row", "doc_id"), F.col("_found") == F.col("_row")).select(
            "_row", "doc_id", "n_shingles", "component_id"
        ),
        "jaccard-members",
    )
    smallest = held(
        members.groupBy("component_id").agg(
            F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("smallest")
        ),
        "jaccard-names",
    )
    return attach(members, smallest, "component_id", "_row", ["smallest"]).select(
        "doc_id", "n_shingles", F.col("smallest").alias("component_id")
    )


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the document with the smallest id, whole rows, in the columns of ``docs``.

    Compared are rows, whose ids may be missing (the smallest) or repeated.
    """
    rows = numbered_in_place(docs, "near-input", compression="zstd")
    found = components_of_texts(rows.select(F.col("_row").alias("doc_id"), "text"), n, percent).select(
        F.col("doc_id").alias("_gone"), "component_id"
    )
    ids = rows.select("_row", "doc_id")
    members = held(
        found.join(ids, F.col("_gone") == F.col("_row")).select("_gone", "component_id", "doc_id"), "near-members"
    )
    heads = held(
        members.groupBy("component_id")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct("doc_id", "_gone")).getField("_gone").alias("head"))
        .filter("group_size > 1"),
        "near-heads",
    )
    gone = attach(members, heads, "component_id", "_gone", ["head"]).filter(F.col("head") != F.col("_gone"))
    return without_rows(rows, gone.select("_gone"), "near-copies")
