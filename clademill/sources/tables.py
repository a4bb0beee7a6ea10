"""Tables and lists that come beside an alignment: taxa, synonymous classes, properties, embeddings, gene lists, result documents."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.model.codes import GeneticCode, code
from clademill.sources.parsers import FormatError, parse_fasta, parse_nexus, sniff

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def taxa_of(text: str) -> list[str]:
    """Names from a list (one a line, or by commas; # begins a comment), or of the sequences of a FASTA or NEXUS text; each once, in order."""
    lead = text.lstrip()
    if lead.startswith(">"):
        names = [n for n, _ in parse_fasta(text)]
    elif lead[:6].lower() == "#nexus":
        names = [n for n, _ in parse_nexus(text).sequences]
    else:
        names = [w.strip() for line in text.splitlines() for w in line.split("#")[0].split(",")]
    return list(dict.fromkeys(n for n in names if n))


def taxon_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) from a file as taxa_of reads it, for a semi join."""
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame([(n,) for n in taxa_of(text.value if text else "")], "name string")


def synonymous_pairs(genetic: GeneticCode) -> list[tuple[str, str]]:
    """Pairs of sense codons of one amino acid that differ in one place, in order."""
    amino = dict(zip(genetic.sense, genetic.aa, strict=True))
    return [(a, b) for a, b in itertools.combinations(sorted(amino), 2) if amino[a] == amino[b] and sum(x != y for x, y in zip(a, b, strict=True)) == 1]


def parse_partition(text: str, genetic_code: str | int = "Universal", *, shared_between: bool = False) -> list[tuple[str, str, str, float | None]]:
    """(codon1, codon2, class, rate) for every synonymous pair, from a table of one of four layouts:

    amino acid, codon, codon, class; codon, codon, class (or a number: a fixed rate); amino acid, codon pair as six letters, class; amino acid, codon, class of the codon (pairs of two classes are a
    class of their own, or all one if shared_between). A first row without a codon is a header. Pairs that the table leaves out are of class `neutral`; a layout of rates or of codon classes must be complete."""
    genetic = code(genetic_code)
    sense = set(genetic.sense)
    split = lambda line: [c.strip() for c in (line.split("\t") if "\t" in line else line.split())]
    rows = [r for line in text.splitlines() if line.strip() and line.strip()[0] != "#" and len(r := split(line.strip())) >= 3]
    codon = lambda s: s.upper().replace("U", "T") in sense
    six = lambda s: len(s) == 6 and codon(s[:3]) and codon(s[3:])
    if rows and not codon(rows[0][0]) and not codon(rows[0][1]) and not six(rows[0][1]):
        rows = rows[1:]
    if not rows:
        raise FormatError("the partition table has no row")
    norm = lambda *c: tuple(sorted(x.upper().replace("U", "T") for x in c))
    pairs, first = synonymous_pairs(genetic), rows[0]

    def number(s: str) -> float | None:
        try:
            return float(s)
        except ValueError:
            return None

    if len(first) >= 4 and codon(first[1]) and codon(first[2]):
        found = {norm(r[1], r[2]): r[3] for r in rows if len(r) >= 4}
    elif codon(first[0]) and codon(first[1]):
        found = {norm(r[0], r[1]): r[2] for r in rows}
        rates = {k: number(v) for k, v in found.items()}
        if None not in rates.values():
            if missing := [p for p in pairs if p not in rates]:
                raise FormatError(f"no rate for {'|'.join(missing[0])}")
            return [(*p, "Empirical", rates[p]) for p in pairs]
    elif six(first[1]):
        found = {norm(r[1][:3], r[1][3:]): r[2] for r in rows if len(r[1]) == 6}
    elif codon(first[1]):
        of = {norm(r[1])[0]: r[2] for r in rows}
        if missing := sorted({c for p in pairs for c in p} - of.keys()):
            raise FormatError(f"no class for {missing[0]}")
        between = lambda a, b: a if a == b else "BETWEEN_CLASSES" if shared_between else "__".join(sorted((a, b)))
        return [(*p, between(of[p[0]], of[p[1]]), None) for p in pairs]
    else:
        raise FormatError("the partition table has none of the four layouts")
    return [(*p, found.get(p, "neutral"), None) for p in pairs]


def partition_table(spark: SparkSession, path: str, genetic_code: str | int = "Universal", *, shared_between: bool = False) -> DataFrame:
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse_partition(text.value if text else "", genetic_code, shared_between=shared_between), "codon1 string, codon2 string, class string, rate double")


def property_table(spark: SparkSession, path: str) -> DataFrame:
    """(property, aa, value, z): amino-acid properties from JSON, an object of twenty letters or a list in the order of AMINO for each name; z has mean 0 and standard deviation 1 over the twenty."""
    text = F.col("value")
    named = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, "map<string,string>")).alias("property", "given"))
    by_letter = F.from_json("given", "map<string,double>")
    in_order = F.from_json("given", "array<double>")
    letters = F.array(*map(F.lit, AMINO))
    values = F.when(F.substring(F.trim("given"), 1, 1) == "[", F.map_from_arrays(letters, F.when(F.size(in_order) == 20, in_order))).otherwise(by_letter)
    long = named.select("property", F.explode(letters).alias("aa"), values.alias("v")).select("property", "aa", F.element_at("v", F.col("aa")).alias("value"))
    checked = long.withColumn("value", F.coalesce("value", F.raise_error(F.concat(F.lit("property "), "property", F.lit(" has no value for "), "aa")).cast("double")))
    stats = checked.groupBy("property").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return checked.join(stats, "property").select("property", "aa", "value", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("z"))


def embedding_problems(taxa: DataFrame, embeddings: DataFrame, name: str = "name", vector: str = "vector") -> DataFrame:
    """(problem, name): taxa without an embedding, embeddings of no taxon, names that occur more than once, and vectors whose length is not the most common one."""
    n = embeddings.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))  # one row
    kinds = [
        ("missing", taxa.select(name).distinct().join(embeddings.select(name), name, "left_anti")),
        ("unknown", embeddings.select(name).distinct().join(taxa.select(name), name, "left_anti")),
        ("duplicate", embeddings.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name)),
        ("ragged", embeddings.crossJoin(F.broadcast(n)).where(F.size(vector) != F.col("size")).select(name).distinct()),
    ]
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("problem"), F.col(name).alias("name")) for k, df in kinds))


def join_embeddings(taxa: DataFrame, embeddings: DataFrame, name: str = "name", vector: str = "vector") -> DataFrame:
    """Taxa with their vectors by name; an error that names the first problems if there is any."""
    if found := embedding_problems(taxa, embeddings, name, vector).orderBy("problem", "name").limit(5).collect():
        raise ValueError("; ".join(f"{r.problem} {r.name}" for r in found))
    return taxa.join(embeddings.select(name, vector), name)


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, alignment, tree) from a list of files, one gene a line: the alignment and, behind white space, the tree if there is one. # begins a comment. File texts are read by the tasks, whole."""
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+").alias("w")).where("w[0] <> ''")
    rows = lines.select(F.col("w")[0].alias("a"), F.get("w", F.lit(1)).alias("t")).distinct()
    paths = [p for r in rows.collect() for p in (r.a, r.t) if p]  # names of files only
    if not paths:
        return spark.createDataFrame([], "dataset_id string, alignment string, tree string")
    texts = spark.read.text(sorted(set(paths)), wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("p"), "value")
    there = lambda c: F.regexp_replace(c, "^file:/+", "/")
    with_a = rows.join(texts.select(F.col("p").alias("pa"), F.col("value").alias("alignment")), there(F.col("a")) == F.col("pa"))
    return with_a.join(texts.select(F.col("p").alias("pt"), F.col("value").alias("tree")), there(F.col("t")) == F.col("pt"), "left").select(F.col("a").alias("dataset_id"), "alignment", "tree")


def tree_source(alignment: str, option: str | None) -> str:
    """Where a run's tree comes from: `file` for a path, `network` or `infer` if asked for (`ohmic`, `auto`), else `embedded` where the alignment has one, else `infer`."""
    if option and option.lower() == "ohmic":
        return "network"
    if option and option.lower() != "auto":
        return "file"
    return "infer" if option else "embedded" if sniff(alignment) == "nexus" and parse_nexus(alignment).trees else "infer"


def preference_at(preferences: DataFrame, site: int, aa: str) -> DataFrame:
    """The preference of one amino acid at one site, from rows of (site, preferences map)."""
    return preferences.where(F.col("site") == site).select("site", F.lit(aa).alias("aa"), F.element_at("preferences", aa).alias("preference"))


def check_preferences(preferences: DataFrame, sites: int) -> None:
    """Preferences must be there for each codon site of the alignment, and no more."""
    found = preferences.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("d")).first()
    if found.n != sites or found.d != sites:
        raise ValueError(f"preferences for {found.d} sites in {found.n} rows, the alignment has {sites}")


# The methods that a result document's information text may begin with.
METHODS = "fel meme fubar slac absrel busted relax prime gard contrast-fel mss".split()


def detect_method(doc: Column) -> Column:
    """struct(method, format) of a result document (JSON text): by its id, by its information text, else by its layout. Newer documents are v3; older ones v2 or v3-legacy by their run time and version."""
    at = lambda path: F.get_json_object(doc, path)
    has = lambda path: at(path).isNotNull()
    ident, info = F.lower(at("$.analysis.id")), at("$.analysis.info")
    text = F.ltrim(F.lower(info))
    lead = F.regexp_extract(text, "^[a-z0-9-]*", 0)
    headers = F.coalesce(at("$.MLE.headers"), F.lit(""))
    names = F.lower(headers)
    by_info = F.when(lead.isin(*METHODS), lead).when(text.contains("(fubar"), "fubar").when(text.startswith("directional fel"), "dfel").when(text.contains("ohmic"), "ohmic")
    layout = (
        F.when(has("$.MLE.content['0']['by-site']"), "slac").when(has("$.grid") & has("$.posterior"), "fubar").when(headers.contains('"P-value (overall)"'), "contrast-fel").when(headers.contains('"PRIME LogL"'), "prime")
        .when(has("$.fits['Unconstrained model']") & has("$['test results']['p-value']"), "busted").when(has("$['test results']['positive test results']"), "absrel")
        .when(has("$['test results']['relaxation or intensification parameter']"), "relax").when(F.substring(at("$.breakpointData"), 1, 1) == "{", "gard")
        .when(names.rlike(r'"[^"]*beta[^"]*(\+|plus)'), "meme").when(names.contains('"alpha=beta"'), "fel")
    )
    runtime, version = at("$.runtime"), F.coalesce(at("$.analysis.version"), F.lit(""))
    old = F.when(runtime.startswith("2."), "v2").when(runtime.isNotNull() | version.contains("next") | version.startswith("3.") | (info.isNotNull() & ~F.coalesce(info, F.lit("")).contains("\n")), "v3-legacy").otherwise("v2")
    alias = F.when(ident.isin("contrast_fel", "contrastfel"), "contrast-fel").when(ident.isin("directional-fel", "directional_fel"), "dfel").otherwise(ident)
    return F.struct(F.when(ident.isNotNull(), alias).otherwise(F.coalesce(by_info, layout)).alias("method"), F.when(ident.isNotNull(), F.lit("v3")).otherwise(old).alias("format"))


def result_rows(docs: DataFrame, doc_id: str, doc: str) -> DataFrame:
    """(doc_id, partition, site, column, value): the site table of result documents, rows of its content under the names of its headers; sites from 1 in each partition."""
    text = F.col(doc)
    pairs = F.from_json(F.get_json_object(text, "$.MLE.headers"), "array<array<string>>")
    named = F.map_keys(F.from_json(F.get_json_object(text, "$.MLE.headers"), "map<string,string>"))
    headers = F.when(F.substring(F.get_json_object(text, "$.MLE.headers"), 1, 1) == "{", named).otherwise(F.transform(pairs, lambda h: h[0]))
    content = F.from_json(F.get_json_object(text, "$.MLE.content"), "map<string,array<array<double>>>")
    parts = docs.select(doc_id, headers.alias("h"), F.explode(content).alias("partition", "rows"))
    sites = parts.select(doc_id, "h", "partition", F.posexplode("rows").alias("s", "row"))
    cells = sites.select(doc_id, "partition", (F.col("s") + 1).alias("site"), F.explode(F.arrays_zip(F.col("h").alias("column"), F.col("row").alias("value"))).alias("c"))
    return cells.select(doc_id, "partition", "site", "c.column", "c.value")
