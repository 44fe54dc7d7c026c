"""Edges between files along place (WHERE), content (WHAT), owner (WHO) and usability (CONVEYANCE).

Three of these relations join every file to every file of a group, so a directory or suffix holding a
third of all files would mean trillions of rows. Their weights, however, depend only on a few
properties of the two ends. They are therefore kept factorised: files are folded into profile cells
before any shuffle, and pairs are counted between cells (at most 48 profiles per group). Equality of
permissions and owner enters by inclusion and exclusion. The counts are exact. `edges_of` lists the
edges of given files, whose number is linear in the files.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.session import cut_lineage

# Weights of the relations.
SIBLING = 0.8
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini"]
TEXT_SUFFIXES = [".md", ".rst", ".txt"]
LARGE = 100_000_000


def directories(files: DataFrame) -> DataFrame:
    """Every directory above a file, once, with its parent."""
    d = files.select("parent").distinct().select(F.explode(F.concat(P.ancestors(F.col("parent")), F.array("parent"))).alias("path")).distinct()
    return d.select("path", P.parent(F.col("path")).alias("parent"), P.name(F.col("path")).alias("name"), F.size(P.parts(F.col("path"))).alias("depth"))


def nodes(files: DataFrame) -> DataFrame:
    d = directories(files).select("path", "parent", F.lit("directory").alias("node_type"))
    return d.unionByName(files.select("path", "parent", F.lit("file").alias("node_type")))


def contains_edges(files: DataFrame) -> DataFrame:
    """Parent to child. Every parent of a node is a directory by construction, but for the empty one above the root."""
    return nodes(files).where("parent <> ''").select(
        F.col("parent").alias("src"), F.col("path").alias("dst"), F.lit(1.0).alias("weight"), F.lit("contains").alias("relationship")
    )


def sibling_counts(files: DataFrame) -> DataFrame:
    """Ordered pairs of nodes with the same parent."""
    g = nodes(files).groupBy("parent").agg(F.count("*").alias("n"))
    return g.where("n > 1").select("parent", F.lit(SIBLING).alias("weight"), (F.col("n") * (F.col("n") - 1)).alias("n_edges"))


# ---- pair counts between profile cells ---------------------------------------------------------------


def stratum(size: Column) -> Column:
    """0: two of these never average above LARGE; 1: depends on the partner; 2: always above."""
    return F.when(size <= LARGE, 0).when(size <= 2 * LARGE, 1).otherwise(2)


def profile(df: DataFrame) -> Column:
    bit = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return bit("readable") + bit("encrypted") * 2 + bit("compressed") * 4 + bit("special_tool") * 8 + stratum(F.coalesce("size", F.lit(0))) * 16


_COMBOS = """inline(flatten(transform(cells, a -> transform(filter(cells, b -> b.code >= a.code),
    b -> struct(a.code AS ca, b.code AS cb, if(a.code = b.code, a.n * (a.n - 1) div 2, a.n * b.n) AS pairs)))))"""

# Pairs are counted among all files of a group, among those of equal permissions, of equal owner, of both.
_KINDS = {"all": (False, False), "p": (True, False), "o": (False, True), "po": (True, True)}


def _by_kind(cells: DataFrame) -> DataFrame:
    """Each cell once per kind of equality, with the keys that kind compares; other keys are blank. An
    unknown owner or permission equals no other, so such cells are left out where it is compared."""
    held = lambda on, c: F.col(c).cast("string") if on else F.lit("")
    kinds = [F.struct(F.lit(k).alias("kind"), held(p, "perms").alias("_p"), held(o, "owner").alias("_o")) for k, (p, o) in _KINDS.items()]
    return cells.select("*", F.inline(F.array(*kinds))).where("_p IS NOT NULL AND _o IS NOT NULL").drop("perms", "owner")


def _digits(value: Column) -> Column:
    """27-bit value as three 9-bit digits with their prefixes."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("lvl"), F.floor(value / (1 << (9 * (3 - k)))).cast("long").alias("prefix"), (F.floor(value / (1 << (9 * (2 - k)))) % 512).cast("int").alias("digit"))
            for k in range(3)
        ]
    )


def _large_mixed(sized: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of a small and a mid-size file whose average exceeds LARGE.

    size_s > 2*LARGE - size_m is split at the first digit where the two differ, which turns the
    comparison into an equi-join on the shared prefix.
    """
    key = by + ["kind", "_p", "_o", "lvl", "prefix"]
    rows = _by_kind(sized)
    keep = [*by, "kind", "_p", "_o", "code", "n"]
    small = rows.where("code < 16").select(*keep, F.inline(_digits(F.col("size"))))
    mid = rows.where("code >= 16").select(*keep, F.inline(_digits(F.lit(2 * LARGE) - F.col("size"))))
    s = small.groupBy(*key, F.col("code").alias("ca"), "digit").agg(F.sum("n").alias("ns"))
    m = mid.groupBy(*key, F.col("code").alias("cb"), F.col("digit").alias("mdigit")).agg(F.sum("n").alias("nm"))
    hit = s.join(m, key).where("digit > mdigit")
    return hit.groupBy(*by, "ca", "cb", F.concat(F.lit("l_"), "kind").alias("kind")).agg(F.sum(F.col("ns") * F.col("nm")).alias("pairs"))


def pair_counts(files: DataFrame, by: list[str]) -> DataFrame:
    """Unordered file pairs within each `by` group, counted by the properties that set their weight.

    The files are folded into cells once and the cells written out; all further work is on cells.
    """
    coded = files.select(*by, "perms", "owner", profile(files).alias("code"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    cells = cut_lineage(coded.groupBy(*by, "perms", "owner", "code").agg(F.count("*").alias("n")))
    group = [*by, "kind", "_p", "_o"]
    per = _by_kind(cells).groupBy(*group, "code").agg(F.sum("n").alias("n"))
    packed = per.groupBy(*group).agg(F.collect_list(F.struct("code", "n")).alias("cells"))  # at most 48 cells
    every = packed.select(*by, F.concat(F.lit("n_"), "kind").alias("kind"), F.expr(_COMBOS))
    if cells.where("code BETWEEN 16 AND 31").take(1):
        sized = coded.where("code < 32").groupBy(*by, "perms", "owner", "code", "size").agg(F.count("*").alias("n"))
        every = every.unionByName(_large_mixed(sized, by))
    kinds = [f"{x}_{k}" for x in ("n", "l") for k in _KINDS]
    wide = every.groupBy(*by, "ca", "cb").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("pairs"))), F.lit(0)).alias(k) for k in kinds])
    sa, sb = F.floor(F.col("ca") / 16), F.floor(F.col("cb") / 16)
    mixed = (sa == 0) & (sb == 1)

    def four(prefix: str, large, minus: bool):
        v = {k: (F.col("n_" + k) - F.col("l_" + k)) if minus else F.col(prefix + "_" + k) for k in _KINDS}
        mk = lambda p, o, n: F.struct(F.lit(p).alias("same_perms"), F.lit(o).alias("same_owner"), large.alias("large"), n.cast("long").alias("n_pairs"))
        return [mk(True, True, v["po"]), mk(True, False, v["p"] - v["po"]), mk(False, True, v["o"] - v["po"]), mk(False, False, v["all"] - v["p"] - v["o"] + v["po"])]

    split = F.array(*(four("l", F.lit(True), False) + four("n", F.lit(False), True)))
    plain = F.array(*four("n", (sa + sb) >= 2, False))
    rows = wide.select(*by, "ca", "cb", F.inline(F.when(mixed, split).otherwise(plain))).where("n_pairs > 0")
    either = lambda bit: ((F.col("ca").bitwiseOR(F.col("cb"))).bitwiseAND(F.lit(bit)) > 0)
    flags = rows.select(
        *by, "same_perms", "same_owner", "large", "n_pairs",
        (F.col("ca").bitwiseAND(F.col("cb")).bitwiseAND(F.lit(1)) > 0).alias("both_readable"),
        either(2).alias("encrypted"), either(4).alias("compressed"), either(8).alias("special_tool"),
    )
    return flags.groupBy(*by, *PAIR_FLAGS).agg(F.sum("n_pairs").alias("n_pairs"))


PAIR_FLAGS = ["same_perms", "same_owner", "both_readable", "encrypted", "compressed", "special_tool", "large"]


def conveyance_weight() -> Column:
    """Weight from the pair flags: permissions or readability, lowered by barriers, raised for one owner."""
    c = F.col
    w = F.when(c("same_perms"), 0.9).when(c("both_readable"), 0.8).otherwise(0.0)
    for flag, factor in (("encrypted", 0.1), ("compressed", 0.8), ("special_tool", 0.5), ("large", 0.7)):
        w = w * F.when(c(flag), F.lit(factor)).otherwise(F.lit(1.0))
    return F.when(c("same_owner"), F.least(w * 1.1, F.lit(1.0))).otherwise(w)


def conveyance_relationship() -> Column:
    return F.when(F.col("same_perms"), "same_permissions").when(F.col("both_readable"), "both_readable").otherwise("")


def conveyance_barriers() -> Column:
    pairs = [("encrypted", "encryption"), ("compressed", "compression"), ("special_tool", "special_tools"), ("large", "large_size")]
    return F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in pairs]))


def conveyance_counts(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """CONVEYANCE edges (weight above .1) per group and flag combination."""
    p = pair_counts(files, list(by))
    return p.withColumn("weight", conveyance_weight()).where("weight > 0.1")


def who_counts(files: DataFrame) -> DataFrame:
    """Pairs of one owner: same permissions 1.0, else .8."""
    cell = files.groupBy("owner", "perms").agg(F.count("*").alias("n"))
    g = cell.groupBy("owner").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"))
    rows = F.array(
        F.struct(F.lit("same_owner_same_perms").alias("relationship"), F.lit(1.0).alias("weight"), F.col("same").alias("n_pairs")),
        F.struct(F.lit("same_owner_diff_perms").alias("relationship"), F.lit(0.8).alias("weight"), F.expr("n * (n - 1) div 2 - same").alias("n_pairs")),
    )
    return g.select("owner", F.inline(rows)).where("n_pairs > 0")


# ---- content -------------------------------------------------------------------------------------


def base_what(ext: Column) -> Column:
    return F.when(ext.isin(CONFIG_SUFFIXES), 0.7).when(ext.isin(TEXT_SUFFIXES), 0.6).otherwise(0.5)


def _stem_finder(stems: list[str]):
    """Function text -> {stem: imported} over all stems, overlapping ones included."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for s in stems:
        machine.add_word(s, s)
    machine.make_automaton()

    def find(text: str) -> dict[str, bool]:
        found: dict[str, bool] = {}
        for end, s in machine.iter(text):
            if not found.get(s):
                found[s] = _imports(text, end + 1 - len(s))
        return found

    return find


def _imports(text: str, at: int) -> bool:
    return text[max(0, at - 7) : at].endswith("import ") or text[max(0, at - 5) : at].endswith("from ")


def attributes(files: DataFrame) -> DataFrame:
    """The narrow properties of files, written once; contents stay where they are read."""
    return cut_lineage(files.drop("content"))


def mentions(files: DataFrame, flat: DataFrame | None = None, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(path, parent, stem, hit, imported): Python files and the Python stems that occur in their text.

    While the stems are small (counted first) every task searches its texts for all of them at once.
    Beyond that, every stem is some substring of its own length, so the distinct substrings of the
    occurring lengths are joined to the stems. `flat` are the attributes of the same files, if at hand:
    then the texts are read once.
    """
    py = files.where(F.col("ext") == ".py").select("path", "parent", "stem", F.coalesce("content", F.lit("")).alias("content"))
    names = (py if flat is None else flat.where("ext = '.py'")).select("stem").where("stem <> ''").distinct()
    size = names.select(F.length("stem").alias("n")).groupBy("n").agg(F.count("*").alias("c")).collect()  # one row per name length
    lengths = sorted(r["n"] for r in size)
    total = sum((r["n"] * 2 + 64) * r["c"] for r in size)
    known = None
    if total <= broadcast_bytes:
        known = py.sparkSession.sparkContext.broadcast([r["stem"] for r in names.collect()])

    def substrings(text: str) -> dict[str, bool]:
        found: dict[str, bool] = {}
        for n in lengths:
            for i in range(len(text) - n + 1):
                g = text[i : i + n]
                if not found.get(g):
                    found[g] = _imports(text, i)
        return found

    def run(batches):
        find = substrings if known is None else _stem_finder(known.value)
        for pdf in batches:
            rows = [(path, parent, stem, g, imp) for path, parent, stem, text in pdf.itertuples(index=False) for g, imp in find(text).items()]
            yield pd.DataFrame(rows, columns=["path", "parent", "stem", "hit", "imported"])

    grams = py.mapInPandas(run, "path string, parent string, stem string, hit string, imported boolean")
    if known is not None:
        return grams
    return grams.join(names.withColumnRenamed("stem", "hit"), "hit").select("path", "parent", "stem", "hit", "imported")


def _either_count(named: DataFrame, per_stem: DataFrame, m: str) -> DataFrame:
    """Unordered file pairs in which one file names the other, from the counts `m` per stem pair (p names q)."""
    t = named.select("p", "q", F.col(m).alias("m")).where("m > 0")
    into = t.where("p <> q").groupBy("q").agg(F.sum("m").alias("m")).join(per_stem, F.col("q") == per_stem["stem"])
    one = into.agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("v"))
    a, b = t.where("p < q"), t.where("p > q").select(F.col("p").alias("q"), F.col("q").alias("p"), F.col("m").alias("back"))
    both = a.join(b, ["p", "q"]).agg(F.coalesce(-F.sum(F.col("m") * F.col("back")), F.lit(0)).alias("v"))
    own = t.where("p = q").join(per_stem, F.col("p") == per_stem["stem"])
    same = own.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2 - (n - m) * (n - m - 1) div 2")), F.lit(0)).alias("v"))
    return one.unionByName(both).unionByName(same).agg(F.sum("v").alias("v"))


def what_counts(files: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """WHAT edges per suffix and weight: suffix base, raised for Python files that import or name each other."""
    flat = attributes(files) if flat is None else flat
    ext = flat.groupBy("ext").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("total"))
    hits = mentions(files, flat).groupBy(F.col("stem").alias("p"), F.col("hit").alias("q"))
    hits = cut_lineage(hits.agg(F.count("*").alias("n_named"), F.count_if("imported").alias("n_imported")))
    per = flat.where("ext = '.py'").groupBy("stem").agg(F.count("*").alias("n"))
    named = _either_count(hits, per, "n_named").withColumn("kind", F.lit("named"))
    imported = _either_count(hits, per, "n_imported").withColumn("kind", F.lit("imported"))
    kinds = ["total", "named", "imported"]
    rows = ext.select("ext", F.col("total").alias("v"), F.lit("total").alias("kind"))
    rows = rows.unionByName(named.unionByName(imported).withColumn("ext", F.lit(".py")))
    e = rows.groupBy("ext").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("v"))), F.lit(0)).alias(k) for k in kinds])
    e = e.withColumn("base", base_what(F.col("ext")))
    mk = lambda w, n: F.struct(w.alias("weight"), n.cast("long").alias("n_pairs"))
    rows = F.array(mk(F.lit(0.9), F.col("imported")), mk(F.lit(0.7), F.col("named") - F.col("imported")), mk(F.col("base"), F.col("total") - F.col("named")))
    return e.select("ext", F.inline(rows)).groupBy("ext", "weight").agg(F.sum("n_pairs").alias("n_pairs")).where("n_pairs > 0")


_ENDS = ["perms", "owner", "readable", "encrypted", "compressed", "special_tool", "size"]


def pair_flags(a: str, b: str) -> dict[str, Column]:
    """Flags of one concrete pair, from two struct columns."""
    x, y = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    return {
        "same_perms": x("perms") == y("perms"),
        "same_owner": x("owner") == y("owner"),
        "both_readable": x("readable") & y("readable"),
        "encrypted": x("encrypted") | y("encrypted"),
        "compressed": x("compressed") | y("compressed"),
        "special_tool": x("special_tool") | y("special_tool"),
        "large": (x("size") + y("size")) / 2 > LARGE,
    }


def named_siblings(files: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """Python files of one directory that name each other: one row per unordered pair. A directory holds
    each stem once, so a file adds at most as many rows as its own text names."""
    flat = attributes(files) if flat is None else flat
    hits = mentions(files, flat).select("path", "parent", "hit", "imported")
    py = flat.where("ext = '.py'")
    to = py.select("parent", F.col("stem").alias("hit"), F.col("path").alias("other"))
    e = hits.join(to, ["parent", "hit"]).where("path <> other")
    pairs = e.groupBy("parent", F.least("path", "other").alias("src"), F.greatest("path", "other").alias("dst")).agg(F.max("imported").alias("imported"))
    ends = py.select("path", F.struct(*_ENDS).alias("x"))
    j = pairs.join(ends.select(F.col("path").alias("src"), F.col("x").alias("a")), "src").join(ends.select(F.col("path").alias("dst"), F.col("x").alias("b")), "dst")
    return j.select("parent", "src", "dst", F.when(F.col("imported"), 0.9).otherwise(0.7).alias("what"), *[v.alias(k) for k, v in pair_flags("a", "b").items()])


def composite_counts(files: DataFrame, flat: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Composite edges: sibling file pairs of one suffix with a CONVEYANCE edge, weight = product of the three.
    `pairs` are the named siblings, if at hand."""
    flat = attributes(files) if flat is None else flat
    pairs = named_siblings(files, flat) if pairs is None else pairs
    total = pair_counts(flat, ["parent", "ext"]).withColumn("what", base_what(F.col("ext")))
    named = pairs.groupBy("parent", "what", *PAIR_FLAGS).agg(F.count("*").alias("n")).withColumn("ext", F.lit(".py"))
    # a pair that is named leaves the base weight for its own
    moved = F.array(
        F.struct(F.col("what").alias("w"), F.col("n").alias("n_pairs")), F.struct(base_what(F.col("ext")).alias("w"), (-F.col("n")).alias("n_pairs"))
    )
    cols = ["parent", "ext", "what", *PAIR_FLAGS, "n_pairs"]
    shift = named.select("parent", "ext", *PAIR_FLAGS, F.inline(moved)).withColumnRenamed("w", "what")
    every = total.select(*cols).unionByName(shift.select(*cols))
    g = every.groupBy("parent", "ext", "what", *PAIR_FLAGS).agg(F.sum("n_pairs").alias("n_pairs")).where("n_pairs > 0")
    g = g.withColumn("conveyance", conveyance_weight()).where("conveyance > 0.1")
    out = g.groupBy("parent", "ext", "what", "conveyance").agg(F.sum("n_pairs").alias("n_pairs"))
    return out.withColumn("where", F.lit(SIBLING)).withColumn("composite", F.col("where") * F.col("what") * F.col("conveyance"))


def strongest(files: DataFrame, k: int = 5, above: float = 0.5) -> DataFrame:
    """The k strongest composite edges above a weight, both ends looked up; ties by parent, suffix, content weight, src, dst.

    The first k cells hold them. A cell lists its pairs in order of src: named siblings are rows already; of
    others, blocks of src are compared with their directory until enough pairs are found.
    """
    flat = attributes(files)
    named = cut_lineage(named_siblings(files, flat).withColumn("conveyance", conveyance_weight()))
    counts = composite_counts(files, flat, named.drop("conveyance")).where(F.col("composite") > above)
    cells = counts.groupBy("parent", "ext", "what", F.round("conveyance", 6).alias("conveyance"), F.round("composite", 6).alias("composite")).agg(F.sum("n_pairs").alias("n_pairs"))
    rows: list[tuple] = []
    for c in cells.orderBy(F.desc("composite"), "parent", "ext", "what").limit(k).collect():
        want = min(k - len(rows), c["n_pairs"])
        if want <= 0:
            break
        inside = (F.round("conveyance", 6) == c["conveyance"]) & (F.col("conveyance") > 0.1)
        mine = named.where((F.col("parent") == c["parent"]) & (F.lit(c["ext"]) == ".py"))
        if c["ext"] == ".py" and c["what"] > 0.5:
            found = mine.where((F.col("what") == c["what"]) & inside).orderBy("src", "dst").limit(want).select("src", "dst").collect()
        else:
            members = flat.where((F.col("parent") == c["parent"]) & (F.col("ext") == c["ext"])).select("path", F.struct(*_ENDS).alias("x"))
            found, after, n = [], None, 64
            while len(found) < want:
                rest = members if after is None else members.where(F.col("path") > after)
                block = rest.select(F.col("path").alias("src"), F.col("x").alias("a")).orderBy("src").limit(n)
                given = block.collect()
                if not given:
                    break
                block = files.sparkSession.createDataFrame(given, block.schema)
                both = rest.select(F.col("path").alias("dst"), F.col("x").alias("b")).join(F.broadcast(block), F.col("src") < F.col("dst"))
                weighed = both.select("src", "dst", *[v.alias(f) for f, v in pair_flags("a", "b").items()]).withColumn("conveyance", conveyance_weight()).where(inside)
                found += weighed.join(mine.select("src", "dst"), ["src", "dst"], "left_anti").orderBy("src", "dst").limit(want - len(found)).select("src", "dst").collect()
                after, n = given[-1]["src"], min(4096, 4 * n)
        rows += [(len(rows) + i, r["src"], r["dst"], SIBLING, c["what"], c["conveyance"], c["composite"]) for i, r in enumerate(found)]
    edges = files.sparkSession.createDataFrame(rows, "rank int, src string, dst string, where_weight double, what_weight double, conveyance_weight double, composite_weight double")
    for end in ("src", "dst"):
        edges = flat.select(F.col("path").alias(end), P.name(F.col("path")).alias(f"{end}_name")).join(F.broadcast(edges), end)
    return edges.orderBy("rank").select("src", "src_name", "dst", "dst_name", "where_weight", "what_weight", "conveyance_weight", "composite_weight")


def edges_of(files: DataFrame, paths: list[str]) -> DataFrame:
    """All CONVEYANCE and composite-ready pairs of the given files: one row per given file and other file.

    The given files travel with the plan, so all of them are compared in one scan.
    """
    few = files.where(F.col("path").isin(paths)).select("path", "parent", "ext", F.struct(*_ENDS).alias("a")).distinct().collect()  # bounded by the paths asked for
    if not few:
        raise ValueError("no such files")
    kinds = {c: files.schema[c].dataType for c in _ENDS}
    mine = [
        F.struct(F.lit(r["path"]).alias("src"), F.lit(r["parent"]).alias("src_parent"), F.lit(r["ext"]).alias("src_ext"), F.struct(*[F.lit(r["a"][k]).cast(kinds[k]).alias(k) for k in _ENDS]).alias("a"))
        for r in few
    ]
    every = files.select(F.col("path").alias("dst"), "parent", "ext", F.struct(*_ENDS).alias("b"), F.inline(F.array(*mine))).where("src <> dst")
    flags = every.select(
        "src", "dst", (F.col("parent") == F.col("src_parent")).alias("sibling"), (F.col("ext") == F.col("src_ext")).alias("same_ext"), *[v.alias(k) for k, v in pair_flags("a", "b").items()]
    )
    return flags.withColumn("conveyance", conveyance_weight()).where("conveyance > 0.1 OR sibling")


def dimension_pattern(files: DataFrame) -> DataFrame:
    """Directed node pairs of the union of the three edge sets by which dimensions are present."""
    files = attributes(files)

    def conv(by):
        return conveyance_counts(files, by).agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("v"))

    def every(by):
        g = files.groupBy(*by).agg(F.count("*").alias("n"))
        return g.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("v"))

    parts = {
        "c": conv([]), "cp": conv(["parent"]), "ce": conv(["ext"]), "cpe": conv(["parent", "ext"]),
        "tp": every(["parent"]), "te": every(["ext"]), "tpe": every(["parent", "ext"]),
        "sib": sibling_counts(files).agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("v")),
        "con": contains_edges(files).agg(F.count("*").alias("v")),
    }
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("k"), F.col("v").cast("long").alias("v")) for k, d in parts.items()])
    one = rows.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in parts])
    mk = lambda w, t, c, n: F.struct(F.lit(w).alias("where_active"), F.lit(t).alias("what_active"), F.lit(c).alias("conveyance_active"), F.expr(n).alias("n_pairs"))
    table = F.array(
        mk(True, True, True, "cpe"),
        mk(True, True, False, "tpe - cpe"),
        mk(True, False, True, "cp - cpe"),
        mk(True, False, False, "(tp - tpe) - (cp - cpe) + sib - tp + con"),
        mk(False, True, True, "ce - cpe"),
        mk(False, True, False, "(te - tpe) - (ce - cpe)"),
        mk(False, False, True, "c - cp - ce + cpe"),
    )
    return one.select(F.inline(table)).where("n_pairs > 0")
