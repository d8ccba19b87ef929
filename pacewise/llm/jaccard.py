"""Near-duplicate documents by an exact n-gram Jaccard join over a token-group matrix.

Method. Documents with equal shingle sets form a class, of which the smallest id stands
for all. Classes are partitioned into groups of similar documents: candidates share a
minimum hash, and a document joins a group only by a verified link to its leader. The
token-group matrix keeps, for each group, the union of its members' leading shingles, in
one global order that puts frequent shingles last. A document (query) meets a group if
they share such a shingle. How many they share bounds the overlap with any member, and
only groups whose bound reaches the threshold are opened: the whole sets of their members
are compared with the query. All members of a group are linked already, so one link
joins the query to all. Connected components of the links give the result.

Exactness. A pair with Jaccard >= t shares one of the first n - ceil(t n) + 1 shingles of
each set, whatever the order, so no link is missed; every link is verified on whole sets.
The order, the groups and their pieces only steer the work.

Defined cases. A null text is empty; a text without words has an empty set, links with
nothing and is its own component. A null id keeps its row, with a null component. Rows that
repeat an id are one node; each keeps its row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.scale import components, small_side
from pacewise.llm.words import give_back, mix, shingle_sets, tidy
from pacewise.session import reliable

ROUNDS = 3              # minimum hashes that propose group leaders
SAMPLED = 16            # one document in so many tells which shingles are frequent
FREQUENT = 8            # a shingle seen so often in the sample goes last in the order
MOST_FREQUENT = 1 << 20  # so many at most; the rest keep their place. Bounds the broadcast to 8 MB
PIECE = 256             # members or queries of a group that one task holds
ROUTES = 1000           # tasks that one row of a document's routes names
ENTRY_ROWS = 1 << 18    # matrix entries that a task gathers before it hands them on
MEETINGS = 1 << 17      # of queries and groups that a task counts before it hands them on
PIECE_SHINGLES = 1 << 21  # shingles of members or queries that one task holds, on average
BUCKET_ROWS = 400_000   # matrix entries that one task holds

_SKETCH = "doc long, n long, d1 long, d2 long, mins array<long>"
_SET = "grp long, piece int, part int, query boolean, doc long, tokens binary"
_MEET = "q long, g long, c int, i int, j int, n int, m int, eq int, es int"


def need(n, percent: int):
    """Least shingles that a set of ``n`` shares with any partner."""
    return -(-n * percent // 100)


def _sketches(words: int):
    salts = mix(np.arange(101, 101 + ROUNDS, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            out = {"doc": batch.column(0), "n": [], "d1": [], "d2": [], "mins": []}
            for _, tokens in shingle_sets(batch.column(1), words):
                digest = np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
                out["n"].append(len(tokens))
                out["d1"].append(int(digest[0]))
                out["d2"].append(int(digest[1]))
                out["mins"].append([int(mix(tokens ^ s).min().view(np.int64)) for s in salts] if len(tokens) else [])
            yield pa.RecordBatch.from_arrays(
                [out["doc"].cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["d1"], pa.int64()),
                 pa.array(out["d2"], pa.int64()), pa.array(out["mins"], pa.list_(pa.int64()))],
                names=["doc", "n", "d1", "d2", "mins"])
    return run


def _routed_sets(words: int):
    """Rows of a document's whole set, one for each route ``(grp, piece, part, query)``."""
    def run(batches):
        for batch in batches:
            docs, routes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out, held = [], 0
            for row, tokens in shingle_sets(batch.column(1), words):
                blob = tokens.tobytes()
                for r in routes[row]:
                    out.append((r["grp"], r["piece"], r["part"], r["query"], docs[row], blob))
                    held += len(blob)
                if held > 8 << 20:
                    yield _set_batch(out)
                    out, held = [], 0
            if out:
                yield _set_batch(out)
    return run


def _set_batch(rows):
    kinds = (("grp", pa.int64()), ("piece", pa.int32()), ("part", pa.int32()), ("query", pa.bool_()),
             ("doc", pa.int64()), ("tokens", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)],
                                      names=[n for n, _ in kinds])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * 100 >= percent * (len(both) - shared)


def _verified(percent: int):
    """Links of the queries of one piece of a group with its members, one for each query at most."""
    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        docs = table.column("doc").to_numpy()
        column = table.column("tokens")
        member = [(docs[i], np.frombuffer(column[i].as_py(), np.uint64)) for i in np.flatnonzero(~query)]
        a, b = [], []
        for i in np.flatnonzero(query):
            tokens = np.frombuffer(column[i].as_py(), np.uint64)
            for other, theirs in member:
                if similar(tokens, theirs, percent):
                    a.append(docs[i])
                    b.append(other)
                    break
        del member
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _parts(sets, shingles):
    """Parts of bounded size for a number of sets with so many shingles together."""
    return F.ceil(F.greatest(sets / PIECE, shingles / PIECE_SHINGLES)).cast("int")


def _linked(documents: DataFrame, routes: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` along ``routes (doc, grp, piece, part, query)``."""
    # A document with very many routes has several rows of them.
    some = ((F.col("piece") + F.col("part")) / ROUTES).cast("int")
    per_doc = reliable(routes.groupBy("doc", some.alias("some"))
                       .agg(F.collect_list(F.struct("grp", "piece", "part", "query")).alias("routes")))
    sets = (documents.join(small_side(per_doc, F.size("routes") * 40 + 64), "doc").select("doc", "text", "routes")
            .mapInArrow(tidy(_routed_sets(words)), _SET))
    return sets.groupBy("grp", "piece", "part").applyInArrow(_verified(percent), "a long, b long")


# --- groups ------------------------------------------------------------------------

def _groups(documents: DataFrame, classes: DataFrame, words: int, percent: int):
    """Star links of similar documents, and ``(doc, grp)`` for documents of groups above one."""
    keys = classes.select("doc", "n", F.posexplode("mins").alias("round", "least"))
    leaders = (keys.groupBy("round", "least").agg(F.min("doc").alias("grp"), F.count(F.lit(1)).alias("size"))
               .where("size > 1"))
    stars = reliable(keys.join(leaders, ["round", "least"]).where(F.col("doc") != F.col("grp"))
                     .select("doc", "grp", "n").distinct())
    sizes = stars.groupBy("grp").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    # the leader is the one member; its followers are the queries, in parts of bounded size
    routes = (stars.join(sizes, "grp")
              .select("doc", "grp", F.lit(0).alias("piece"), F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"),
                      F.lit(True).alias("query"))
              .unionByName(sizes.select(F.col("grp").alias("doc"), "grp", F.lit(0).alias("piece"),
                                        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                        F.lit(False).alias("query"))))
    links = reliable(_linked(documents, routes, words, percent))
    first = links.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("grp"))
    over = first.select(F.col("doc").alias("grp"), F.col("grp").alias("top"))
    joined = first.join(over, "grp", "left").select("doc", F.coalesce("top", "grp").alias("grp"))
    joined = joined.where(F.col("doc") != F.col("grp"))
    # a document that follows another cannot head a group of its own
    heads = joined.select(F.col("grp").alias("doc")).distinct().join(joined.select("doc"), "doc", "left_anti")
    return links, joined.unionByName(heads.select("doc", F.col("doc").alias("grp")))


# --- token-group matrix --------------------------------------------------------------

def _buckets_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(tokens) % np.uint64(buckets)).astype(np.int64)


def _sampled_tokens(words: int, buckets: int):
    def run(batches):
        for batch in batches:
            held = [tokens for _, tokens in shingle_sets(batch.column(0), words)]
            tokens = np.concatenate(held) if held else np.zeros(0, np.uint64)
            at = _buckets_of(tokens, buckets)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(buckets + 1))
            some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([tokens[order[cuts[b]:cuts[b + 1]]].tobytes() for b in some], pa.binary())],
                names=["bucket", "tokens"])
    return run


def _often(table: pa.Table) -> pa.Table:
    tokens = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")])
    values, counts = np.unique(tokens, return_counts=True)
    keep = counts >= FREQUENT
    return pa.table({"token": values[keep].view(np.int64), "times": counts[keep]})


def frequent_tokens(documents: DataFrame, words: int, total: int) -> np.ndarray:
    """Sorted shingles that are frequent in a sample of the documents; they only order the matrix."""
    buckets = max(1, -(-total // SAMPLED // BUCKET_ROWS))
    sample = documents.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).select("text")
    often = (sample.mapInArrow(tidy(_sampled_tokens(words, buckets)), "bucket int, tokens binary")
             .groupBy("bucket").applyInArrow(_often, "token long, times long"))
    top = often.orderBy(F.desc("times"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


_FIELDS = (("token", np.uint64), ("doc", np.int64), ("grp", np.int64), ("n", np.int32), ("i", np.int32),
           ("e", np.uint16), ("size", np.uint8))


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sort keys of a set: hash order, with the frequent shingles after all others."""
    keys = tokens >> np.uint64(1)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        keys |= (frequent[np.minimum(at, len(frequent) - 1)] == tokens).astype(np.uint64) << np.uint64(63)
    keys.sort()
    return keys


def _entries(words: int, percent: int, buckets: int, frequent):
    """Leading shingles of every document, packed by bucket. Columns: doc, text, grp, size."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            docs, groups, sizes = (batch.column(i).to_pylist() for i in (0, 2, 3))
            held: dict[str, list] = {name: [] for name, _ in _FIELDS}
            count = 0
            for row, tokens in shingle_sets(batch.column(1), words):
                n = len(tokens)
                if n:
                    keys = ordered(tokens, frequent.value)[:n - need(n, percent) + 1]
                    held["token"].append(keys)
                    held["i"].append(np.arange(1, len(keys) + 1))
                    for name, value in (("doc", docs[row]), ("grp", groups[row]), ("n", n),
                                        ("e", int(keys[-1]) >> 48), ("size", min(255, sizes[row]))):
                        held[name].append(np.full(len(keys), value))
                    count += len(keys)
                if count > ENTRY_ROWS:
                    yield _packed(held, buckets, pack)
                    held, count = {name: [] for name, _ in _FIELDS}, 0
            if count:
                yield _packed(held, buckets, pack)
    return run


def _packed(held, buckets: int, pack) -> pa.RecordBatch:
    columns = {name: np.concatenate(held[name]).astype(kind) for name, kind in _FIELDS}
    at = _buckets_of(columns["token"], buckets)
    order = np.lexsort((columns["token"], at))
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    columns["grp"] = columns["grp"] - columns["doc"]
    some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    blobs = [pack.compress(b"".join(columns[name][order[cuts[b]:cuts[b + 1]]].tobytes() for name, _ in _FIELDS)) for b in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([int(cuts[b + 1] - cuts[b]) for b in some], pa.int32()), pa.array(blobs, pa.binary())],
        names=["bucket", "rows", "entries"])


def _unpacked(table: pa.Table) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {name: [] for name, _ in _FIELDS}
    unpack = zstandard.ZstdDecompressor()
    for rows, blob in zip(table.column("rows").to_pylist(), table.column("entries")):
        raw, at = unpack.decompress(blob.as_py()), 0
        for name, kind in _FIELDS:
            size = rows * np.dtype(kind).itemsize
            parts[name].append(np.frombuffer(raw[at:at + size], kind))
            at += size
    columns = {name: np.concatenate(x) for name, x in parts.items()}
    columns["grp"] = columns["grp"] + columns["doc"]
    return columns


def _meetings(percent: int):
    """Queries and groups that share a shingle of one bucket of the matrix, with counts, a part at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _unpacked(pa.Table.from_batches(list(batches)))
        order = np.lexsort((x["grp"], x["size"], x["token"]))
        x = {name: column[order] for name, column in x.items()}
        new = np.r_[True, x["token"][1:] != x["token"][:-1]]
        run_at = np.flatnonzero(new)
        run_end = np.r_[run_at[1:], len(new)]
        # in a run, one entry per group stands for the group
        head = new | np.r_[True, x["grp"][1:] != x["grp"][:-1]]
        heads = np.flatnonzero(head)
        h_from = np.searchsorted(heads, run_at)
        h_end = np.searchsorted(heads, run_end)
        open_runs = np.flatnonzero(h_end - h_from > 1)
        # each entry meets the groups that come after its own in the run
        lengths = run_end[open_runs] - run_at[open_runs]
        entry = np.repeat(run_at[open_runs] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        begin = np.searchsorted(heads, entry, "right")
        count = np.repeat(h_end[open_runs], lengths) - begin
        entry, begin, count = entry[count > 0], begin[count > 0], count[count > 0]
        steps = np.r_[0, np.cumsum(count)]
        at = 0
        while at < len(entry):
            end = max(at + 1, int(np.searchsorted(steps, steps[at] + MEETINGS, "right")) - 1)
            c = count[at:end]
            q = np.repeat(entry[at:end], c)
            g = heads[np.repeat(begin[at:end] - (steps[at:end] - steps[at]), c) + np.arange(c.sum())]
            one = x["size"][g] == 1
            n, m = x["n"][q].astype(np.int64), x["n"][g].astype(np.int64)
            keep = ~one | ((m * 100 >= n * percent) & (n * 100 >= m * percent))
            yield _counted(x, q[keep], g[keep], one[keep])
            at = end
        give_back()
    return run


def _counted(x, q, g, one) -> pa.RecordBatch:
    pairs = np.lexsort((x["grp"][g], x["doc"][q]))
    q, g, one = q[pairs], g[pairs], one[pairs]
    docs, groups = x["doc"][q], x["grp"][g]
    start = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (groups[1:] != groups[:-1])]) if len(q) else np.zeros(0, int)
    top = lambda v: np.maximum.reduceat(v, start).astype(np.int32) if len(v) else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(docs[start]), pa.array(groups[start]), pa.array(np.diff(np.r_[start, len(q)]).astype(np.int32)),
         pa.array(top(x["i"][q])), pa.array(top(np.where(one, x["i"][g], 0))), pa.array(top(x["n"][q])),
         pa.array(top(np.where(one, x["n"][g], 0))), pa.array(top(x["e"][q])), pa.array(top(np.where(one, x["e"][g], 0)))],
        names=["q", "g", "c", "i", "j", "n", "m", "eq", "es"])


def _bound(percent: int):
    """Columns that tell whether query and group can link. ``m`` is 0 for a group above one; lo and hi are its sizes."""
    n, m, c = (F.col(x).cast("long") for x in ("n", "m", "c"))
    least = lambda v: F.floor((v * percent + 99) / F.lit(100))  # noqa: E731  # rest beyond the prefix, plus 1
    rest_q, rest_s = least(n) - 1, least(m) - 1
    wanted = lambda a, b: F.ceil((a + b) * percent / F.lit(100 + percent))
    # Up to the smaller prefix end both lists are complete; beyond it only the rest of that set can be shared.
    ends = (F.when(F.col("eq") < F.col("es"), rest_q).when(F.col("eq") > F.col("es"), rest_s)
            .otherwise(F.greatest(rest_q, rest_s)))
    single = F.least(c + ends, c + n - F.col("i"), c + m - F.col("j")) >= wanted(n, m)
    hi = F.least(F.col("hi"), F.floor(n * 100 / F.lit(percent)))
    lo = F.greatest(F.col("lo"), least(n))
    # Whichever member: what it needs is least for the smallest, what may be left most for the largest.
    many = (lo <= hi) & (c + F.greatest(rest_q, least(hi) - 1) >= wanted(n, lo))
    return F.when(m > 0, single).otherwise(many)


def _opened(documents: DataFrame, members: DataFrame, groups: DataFrame, words: int, percent: int, total: int) -> DataFrame:
    """Links between queries and members of the groups that the matrix cannot exclude."""
    spark = documents.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(documents, words, total))
    buckets = max(8, -(-total * (100 - percent) // 100 // BUCKET_ROWS))
    placed = (documents.join(small_side(members, 64), "doc", "left")
              .where(F.coalesce(~F.col("copy"), F.lit(True)))
              .select("doc", "text", F.coalesce("grp", "doc").alias("grp"), F.coalesce("size", F.lit(1)).alias("size")))
    entries = placed.mapInArrow(tidy(_entries(words, percent, buckets, frequent)), "bucket int, rows int, entries binary")
    met = (entries.groupBy("bucket").applyInArrow(_meetings(percent), _MEET).groupBy("q", "g")
           .agg(F.sum("c").alias("c"), *[F.max(k).alias(k) for k in ("i", "j", "n", "m", "eq", "es")]))
    opened = reliable(met.join(groups.select(F.col("grp").alias("g"), "lo", "hi"), "g", "left")
                      .where(_bound(percent)).select("q", "g", "n"))
    crowd = opened.groupBy("g").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    inside = (members.where(~F.col("copy")).select("doc", F.col("grp").alias("g"))
              .unionByName(opened.select(F.col("g").alias("doc"), "g")).distinct())
    plan = crowd.join(groups.select(F.col("grp").alias("g"), _parts(F.col("size"), F.col("size") * F.col("hi")).alias("pieces")), "g", "left")
    plan = reliable(plan.withColumn("pieces", F.coalesce("pieces", F.lit(1))))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    routes = (opened.join(plan, "g")
              .select(F.col("q").alias("doc"), F.col("g").alias("grp"), all_of("pieces").alias("piece"),
                      F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("query"))
              .unionByName(inside.join(plan, "g")
                           .select("doc", F.col("g").alias("grp"), F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int").alias("piece"),
                                   all_of("parts").alias("part"), F.lit(False).alias("query"))))
    return _linked(documents, routes, words, percent)


# --- result -------------------------------------------------------------------------

def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id)`` for every row.

    Two documents link if ``100 * |A and B| >= percent * |A or B|`` over their sets of
    ``words``-word shingles, A-Z folded. ``component_id`` is the smallest id reachable by
    links, ``class_id`` the smallest id with the same set.
    """
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.col(f"`{text_column}`").alias("text"))
    sketch = reliable(rows.mapInArrow(tidy(_sketches(words)), _SKETCH))
    filled = sketch.where("n > 0 and doc is not null")
    classes = reliable(filled.groupBy("d1", "d2", "n").agg(F.min("doc").alias("doc"), F.max("mins").alias("mins"),
                                                           F.count(F.lit(1)).alias("copies")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = rows.where(F.col("doc").isNotNull())
    same = (filled.join(classes.where("copies > 1").select("d1", "d2", "n", F.col("doc").alias("rep")), ["d1", "d2", "n"])
            .select("doc", "rep"))
    same = reliable(same.where("doc != rep").distinct())
    links, placed = _groups(texts, classes, words, percent)
    sized = placed.join(classes.select("doc", "n"), "doc")
    groups = reliable(sized.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    members = reliable(placed.join(groups, "grp").select("doc", "grp", "size", F.lit(False).alias("copy"))
                       .unionByName(same.select("doc", F.col("rep").alias("grp"), F.lit(1).cast("long").alias("size"),
                                                F.lit(True).alias("copy"))))
    found = _opened(texts, members, groups, words, percent, total)
    parts = components(links.unionByName(found).unionByName(same.select(F.col("doc").alias("a"), F.col("rep").alias("b"))))
    return (sketch.join(parts.withColumnRenamed("node", "doc"), "doc", "left")
            .join(same, "doc", "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "doc").alias("component_id"), F.coalesce("rep", "doc").alias("class_id")))


def one_of_each_group(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents that have the smallest id of their component. Of rows that repeat an id one stays; a null id stays."""
    found = reliable(near_duplicates(documents, words, percent))
    gone = reliable(found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct())
    kept = documents.join(small_side(gone, 32), F.col("doc_id") == F.col("__gone"), "left_anti")
    counts = found.where("doc_id is not null").agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if counts[0] == counts[1]:
        return kept
    return (kept.where("doc_id is not null").dropDuplicates(["doc_id"])
            .unionByName(kept.where("doc_id is null")))
