"""The corpus analyses: path suffixes, string windows, global strings, pretty printing and entropy coding.

Each takes the locations of all documents and returns DataFrames, per document and, where ``scope`` is ALL, of the corpus;
reports are rendered from those. An analysis that needs another one's results gets them as plans, in one order that
fits all, so any set of analyses runs at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from arborlens.operators import coding, contexts, frequencies, recency, strings
from arborlens.operators.ordering import global_index
from arborlens.schema import views
from arborlens.schema.types import Schema
from arborlens.sources import store as stores
from arborlens.sources.es5 import parse_script
from arborlens.sources.syntax import lift_script
from arborlens.sources.typed_trees import typed_nodes

DOC = "subpath"


def _number(x: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _cut_to(x: Column, times: int, by: int) -> Column:
    return _number(F.floor(x * times) / by)


# Path suffixes


def path_suffix(nodes: DataFrame, schema: Schema, max_len: int = 1, doc: str = DOC) -> DataFrame:
    """(scope, doc, suffix, tag, sym_index, sym_name, hits, total_hits, total_symbols) of all suffix lengths up to ``max_len``.

    Every symbol of a table's alphabet is listed. total_symbols counts all locations, roots too.
    """
    rows = contexts.symbols(contexts.with_suffixes(nodes.where("seq is not null"), max_len))
    alphabet = F.when(F.col("tag") == "type", F.concat(F.lit("type "), "bound")).otherwise(F.col("tag"))
    keys = ["suffix", "tag", "alphabet"]
    hits = frequencies.count_by_doc_and_all(rows.withColumn("alphabet", alphabet).select(doc, *keys, "sym_index"), doc, [*keys, "sym_index"])
    emitted = frequencies.count_by_doc_and_all(nodes.where("seq is not null").select(doc), doc, []).withColumnRenamed("hits", "total_symbols")
    # ALL has no document; an empty name stands for it, so keys can be compared.
    scoped = hits.withColumn(doc, F.coalesce(F.col(doc).cast("string"), F.lit("")))
    full = frequencies.zero_filled(scoped, views.alphabets(nodes.sparkSession, schema), ["scope", doc, *keys])
    full = full.withColumn("total_hits", F.sum("hits").over(Window.partitionBy("scope", doc, *keys)))
    return full.drop("alphabet").join(emitted.withColumn(doc, F.coalesce(F.col(doc).cast("string"), F.lit(""))), ["scope", doc])


def suffix_tables(freq: DataFrame, doc: str = DOC) -> DataFrame:
    """(scope, doc, place, suffix, totalHits, totalSymbols, freqs): a row per table, the most specific first, symbols by falling hits."""
    one = F.struct((-F.col("hits")).alias("k"), "sym_index", "sym_name", "hits")
    t = freq.groupBy("scope", doc, "suffix", "tag").agg(F.max("total_hits").alias("totalHits"), F.max("total_symbols").alias("totalSymbols"), F.array_sort(F.collect_list(one)).alias("fs"))
    t = frequencies.by_specificity(t)
    place = F.row_number().over(Window.partitionBy("scope", doc).orderBy(F.desc("slashes"), F.desc("totalHits"), "suffix", "tag"))
    freqs = F.transform("fs", lambda f: F.struct(f["sym_name"].alias("name"), f["sym_index"].alias("index"), f["hits"].alias("hits")))
    return t.select("scope", doc, place.alias("place"), F.concat("suffix", F.lit("#"), "tag").alias("suffix"), "totalHits", "totalSymbols", freqs.alias("freqs"))


def _joined(lines: DataFrame, doc: str) -> DataFrame:
    """(scope, doc, text) of rows (scope, doc, place, line)."""
    return lines.groupBy("scope", doc).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls")).select("scope", doc, F.array_join(F.transform("ls", lambda x: x["line"]), "").alias("text"))


def _as_json(tables: DataFrame, doc: str, *columns: str) -> DataFrame:
    """(scope, doc, json): one array of objects per document."""
    rows = F.array_sort(F.collect_list(F.struct("place", F.struct(*columns).alias("o"))))
    return tables.groupBy("scope", doc).agg(rows.alias("rs")).select("scope", doc, F.to_json(F.transform("rs", lambda r: r["o"])).alias("json"))


def suffix_report(tables: DataFrame, doc: str = DOC) -> DataFrame:
    """(scope, doc, text)."""
    f = tables.select("scope", doc, "place", "suffix", "totalHits", "totalSymbols", F.posexplode("freqs").alias("i", "f"))
    w = Window.partitionBy("scope", doc, "place").orderBy("i")
    prob = F.col("f.hits") / F.col("totalHits")
    accum = F.sum("f.hits").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("totalHits")
    bits = F.when(F.col("f.hits") > 0, _cut_to(-F.log2(prob), 100, 100)).otherwise("0")
    line = F.concat(F.lit("    "), "f.name", F.lit("\n        hits="), F.col("f.hits").cast("string"), F.lit(", bits="), bits, F.lit(", prob = "), _cut_to(prob, 10000, 100), F.lit(", accum = "), _cut_to(accum, 10000, 100), F.lit("\n\n"))
    lines = f.withColumn("line", line).groupBy("scope", doc, "place", "suffix", "totalHits", "totalSymbols").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    share = F.col("totalHits") / F.col("totalSymbols")
    head = F.concat(F.lit("Suffix "), "suffix", F.lit("\n  [hits="), F.col("totalHits").cast("string"), F.lit("/"), F.col("totalSymbols").cast("string"), F.lit("] "), _cut_to(share, 10000, 100), F.lit("%]\n"))
    return _joined(lines.select("scope", doc, "place", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "")).alias("line")), doc)


# String windows


def string_refs(nodes: DataFrame, doc: str = DOC) -> DataFrame:
    """(doc, seq, str_kind, str_value): identifiers, properties and strings in the order of the walk."""
    return nodes.where("str_kind is not null").select(doc, "seq", "str_kind", "str_value")


def string_window(nodes: DataFrame, sizes: list[int], doc: str = DOC, compat: bool = False) -> DataFrame:
    """(scope, doc, str_kind, window_size, index, count, prob) for every window size, from one pass over each document's strings."""
    ranks = recency.mtf_ranks(string_refs(nodes, doc), [doc, "str_kind"], ["seq"], "str_value", max(sizes))
    both = ranks.select(F.explode(F.array(F.struct(F.lit("doc").alias("scope"), F.col(doc).cast("string").alias(doc)), F.struct(F.lit("ALL").alias("scope"), F.lit("").alias(doc)))).alias("s"), "str_kind", "dist").select("s.*", "str_kind", "dist")
    return recency.window_histograms(both, sizes, ["scope", doc, "str_kind"], compat)


def window_report(windows: DataFrame, doc: str = DOC) -> DataFrame:
    """(scope, doc, window_size, text): tables of identifiers, properties and strings."""
    names = F.create_map(*(F.lit(x) for pair in coding.KINDS.items() for x in pair))
    place = F.when(F.col("index") == "MISSES", F.col("window_size")).when(F.col("index") == "HITS", F.col("window_size") + 1).when(F.col("index") == "TOTAL", F.col("window_size") + 2).otherwise(F.col("index").try_cast("int"))
    w = Window.partitionBy("scope", doc, "str_kind", "window_size").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    rows = windows.withColumn("_p", place)
    rows = rows.withColumn("_a", F.sum("prob").over(w))
    bits = F.when(F.col("prob") > 0, _cut_to(-F.log2("prob"), 100, 100)).otherwise("0")
    line = F.concat(F.lit("    INDEX "), "index", F.lit("\n        hits="), F.col("count").cast("string"), F.lit(", bits="), bits, F.lit(", prob="), _cut_to(F.col("prob"), 1000, 10), F.lit(", accum="), _cut_to(F.col("_a"), 1000, 10), F.lit("\n"))
    table = rows.withColumn("line", line).groupBy("scope", doc, "window_size", "str_kind").agg(F.array_sort(F.collect_list(F.struct("_p", "line"))).alias("ls"))
    table = table.select("scope", doc, "window_size", "str_kind", F.concat(F.lit("Table "), F.element_at(names, F.col("str_kind")), F.lit(":\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "")).alias("t"))
    out = table.groupBy("scope", doc, "window_size").agg(F.array_sort(F.collect_list(F.struct("str_kind", "t"))).alias("ts"))
    return out.select("scope", doc, "window_size", F.concat(F.lit("WindowSize="), F.col("window_size").cast("string"), F.lit("\n"), F.array_join(F.transform("ts", lambda x: x["t"]), "")).alias("text"))


# Global strings


def global_strings(nodes: DataFrame, doc: str = DOC) -> DataFrame:
    """(scope, doc, str, idx, ident_count, prop_count, raw_count, total_count): idx is the order of first appearance, in a
    document by its walk, in the corpus by document and walk."""
    refs = string_refs(nodes, doc).withColumn(doc, F.col(doc).cast("string"))
    per = refs.groupBy(doc, "str_value").agg(*strings.kind_counts("str_kind"), F.count("*").alias("total_count"), F.min("seq").alias("_first"))
    own = per.withColumn("idx", (F.row_number().over(Window.partitionBy(doc).orderBy("_first", "str_value")) - 1).cast("long"))
    whole = per.groupBy("str_value").agg(*(F.sum(c).alias(c) for c in ("ident_count", "prop_count", "raw_count", "total_count")), F.min(F.struct(doc, "_first")).alias("_first"))
    whole = global_index(whole, ["_first", "str_value"]).withColumn(doc, F.lit(""))
    columns = [doc, F.col("str_value").alias("str"), "idx", "ident_count", "prop_count", "raw_count", "total_count"]
    return own.select(F.lit("doc").alias("scope"), *columns).unionByName(whole.select(F.lit("ALL").alias("scope"), *columns))


def strings_report(counts: DataFrame, doc: str = DOC, compat: bool = False) -> DataFrame:
    """(scope, doc, text), the most frequent first. ``compat`` prints ``undefined`` for the string itself."""
    shown = F.lit("undefined") if compat else F.regexp_extract(F.to_json(F.struct(F.col("str").alias("s"))), r'^\{"s":(.*)\}$', 1)
    n = lambda c: F.col(c).cast("string")
    units = (F.octet_length(F.encode("str", "UTF-16BE")) / 2).cast("long").cast("string")
    line = F.concat(F.lit("STRING "), n("idx"), F.lit(" length="), units, F.lit(" identCount="), n("ident_count"), F.lit(" propCount="), n("prop_count"), F.lit(" rawCount="), n("raw_count"), F.lit("\n >> "), shown, F.lit("\n\n"))
    return _joined(counts.select("scope", doc, F.struct((-F.col("total_count")).alias("k"), "idx").alias("place"), line.alias("line")), doc)


# Pretty printing


def pretty_print(nodes: DataFrame, doc: str = DOC) -> DataFrame:
    """(doc, text): every location with its key, bound, shape and value; what is below it is indented.

    A location's closing line comes after those below it: lines are ordered by (last location before the line, closing, depth).
    """
    pad = F.repeat(F.lit("    "), F.col("depth"))
    key = F.coalesce("key_name", F.col("key_index").cast("string"))
    inner = F.regexp_extract("type_name", "<(.*)>$", 1)
    shape = F.when(F.col("type_kind").isin("iface", "enum"), F.concat("type_kind", F.lit("("), inner, F.lit(")"))).otherwise(F.col("type_name"))
    value = F.when(F.col("type_kind").isin("iface", "array"), "").otherwise(F.concat(pad, F.lit("    value = "), F.coalesce("text", F.lit("null")), F.lit("\n")))
    opening = F.concat(pad, key, F.lit(": "), "bound", F.lit(" = {\n"), pad, F.lit("    @ "), shape, F.lit("\n"), pad, F.lit("\n"), value)
    first = F.struct(F.col("seq").alias("at"), F.lit(0).alias("closing"), F.lit(0).alias("up"), opening.alias("line"))
    last = F.struct(F.col("last_seq").alias("at"), F.lit(1).alias("closing"), (-F.col("depth")).alias("up"), F.concat(pad, F.lit("}\n")).alias("line"))
    lines = nodes.where("seq is not null").select(doc, F.explode(F.array(first, last)).alias("l"))
    return lines.groupBy(doc).agg(F.array_sort(F.collect_list("l")).alias("ls")).select(doc, F.array_join(F.transform("ls", lambda x: x["line"]), "").alias("text"))


# The analyses by name


@dataclass
class Corpus:
    """Documents (subpath, size, text), their locations, and the results of analyses so far."""

    spark: SparkSession
    schema: Schema
    files: DataFrame
    nodes: DataFrame
    compat: bool = False
    results: dict = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, schema: Schema, files: DataFrame, *, parser=parse_script, compat: bool = False, errors: str = "raise") -> Corpus:
        """``parser`` turns a script's text into a parser tree (an object); where it is None the texts are such trees as JSON."""
        lift = lambda text: lift_script(schema, parser(text) if parser else text, compat)
        nodes = typed_nodes(files, schema, "Script", id_col=DOC, text_col="text", read=lift, errors=errors)
        return cls(spark, schema, files, nodes.persist(StorageLevel.MEMORY_AND_DISK), compat)


class Analysis:
    """One analysis: subclasses name themselves and what they need, and return their tables by name."""

    name = ""
    needs: tuple[str, ...] = ()

    def __init__(self, **options):
        self.options = options

    def run(self, corpus: Corpus) -> dict[str, DataFrame]:
        raise NotImplementedError

    def reports(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """(subpath, text) by folder: what is written beside the tables."""
        return {}

    @staticmethod
    def _named(df: DataFrame, ending: str, column: str = "text") -> DataFrame:
        name = F.when(F.col("scope") == "ALL", F.lit(f"ALL{ending}")).otherwise(stores.result_path(F.col(DOC), ending))
        return df.select(name.alias("subpath"), F.col(column).alias("text"))


class StringWindow(Analysis):
    name = "string-window"

    @property
    def sizes(self) -> list[int]:
        return self.options.get("sizes") or [recency.DEFAULT_WINDOW]

    def run(self, corpus):
        return {"windows": string_window(corpus.nodes, sorted({*self.sizes, *([recency.DEFAULT_WINDOW] if self.options.get("with_default") else [])}), compat=corpus.compat)}

    def reports(self, tables):
        w = tables["windows"]
        place = F.when(F.col("index") == "MISSES", F.col("window_size")).when(F.col("index") == "HITS", F.col("window_size") + 1).when(F.col("index") == "TOTAL", F.col("window_size") + 2).otherwise(F.col("index").try_cast("int"))
        out = {}
        for size in self.sizes:
            mine = w.where(F.col("window_size") == size)
            kinds = mine.groupBy("scope", DOC, "str_kind").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.struct("index", "count", "prob").alias("o")))).alias("os"))
            kinds = kinds.groupBy("scope", DOC).pivot("str_kind", list(coding.KINDS)).agg(F.first(F.transform("os", lambda x: x["o"])))
            body = F.to_json(F.struct(F.lit(size).alias("windowSize"), *(F.coalesce(F.col(k), F.array()).alias(n) for k, n in coding.KINDS.items())))
            out[f"{self.name}/{size}"] = self._named(kinds.select("scope", DOC, body.alias("text")), ".json").unionByName(self._named(window_report(mine), ".txt"))
        return out


class PrettyPrint(Analysis):
    name = "pretty-print"

    def run(self, corpus):
        return {"text": pretty_print(corpus.nodes)}

    def reports(self, tables):
        return {self.name: self._named(tables["text"].withColumn("scope", F.lit("doc")), ".txt")}


class PathSuffix(Analysis):
    name = "path-suffix"

    def run(self, corpus):
        freq = path_suffix(corpus.nodes, corpus.schema, self.options.get("length", 1))
        return {"freq": freq, "tables": suffix_tables(freq)}

    def reports(self, tables):
        t = tables["tables"]
        js = _as_json(t, DOC, "suffix", "totalHits", "totalSymbols", "freqs")
        return {f"{self.name}/{self.options.get('length', 1)}": self._named(js, ".json", "json").unionByName(self._named(suffix_report(t), ".txt"))}


class GlobalStrings(Analysis):
    name = "global-strings"

    def run(self, corpus):
        return {"strings": global_strings(corpus.nodes)}

    def reports(self, tables):
        s = tables["strings"]
        rows = s.select("scope", DOC, F.struct((-F.col("total_count")).alias("k"), "idx").alias("place"), "str", "idx", F.col("ident_count").alias("identCount"), F.col("prop_count").alias("propCount"), F.col("raw_count").alias("rawCount"), F.col("total_count").alias("totalCount"))
        js = _as_json(rows, DOC, "str", "idx", "identCount", "propCount", "rawCount", "totalCount")
        return {self.name: self._named(js, ".json", "json").unionByName(self._named(strings_report(s, compat=self.options.get("compat", False)), ".txt"))}


class EntropyCode(Analysis):
    """Codes documents of at least ``least_size`` bytes by the models of suffix length 2 and window 64 of the whole corpus."""

    name = "entropy-code"
    needs = ("path-suffix", "string-window", "global-strings")

    def run(self, corpus):
        window, length, least = self.options.get("window", recency.DEFAULT_WINDOW), self.options.get("length", 2), self.options.get("least_size", 100_000)
        freq = path_suffix(corpus.nodes, corpus.schema, length).where("scope = 'ALL'")
        windows = string_window(corpus.nodes, [window], compat=corpus.compat).where("scope = 'ALL'")
        model = coding.table_model(freq).unionByName(coding.string_model(windows, window, corpus.compat))
        words = strings.dictionary(global_strings(corpus.nodes).where("scope = 'ALL'").select(F.col("str").alias("value"), "total_count"))
        large = corpus.files.where(F.col("size") >= least).select(DOC)
        nodes = corpus.nodes.join(large, DOC, "left_semi")
        costed = coding.costs(coding.symbol_rows(nodes, DOC, window, words, length, corpus.compat), model, corpus.compat)
        rolled = coding.rollup(costed, DOC)
        missed = costed.where("c2 = 'escape'").select(DOC, "seq").join(string_refs(nodes), [DOC, "seq"]).join(F.broadcast(words.select(F.col("value").alias("str_value"))), "str_value", "left_anti")
        tables = strings.string_table_size(missed, DOC, "str_value").withColumnRenamed("total_bytes", "string_bytes")
        sizes = stores.compressed_sizes(corpus.files.where(F.col("size") >= least), DOC, "text")
        summary = coding.report(rolled, sizes, tables, DOC)
        return {"model": model, "coded": coding.encode(costed, DOC), "labels": rolled, "summary": summary, "text": coding.report_text(rolled, summary, DOC)}

    def reports(self, tables):
        coded = tables["coded"].select(stores.result_path(F.col(DOC), ".TSC").alias("subpath"), F.col("coded").alias("text"))
        return {self.name: coded, f"{self.name}/report": self._named(tables["text"].withColumn("scope", F.lit("doc")), ".txt")}


#: In the order in which they run.
REGISTRY: dict[str, type[Analysis]] = {a.name: a for a in (StringWindow, PrettyPrint, PathSuffix, GlobalStrings, EntropyCode)}


def analyze(corpus: Corpus, wanted: dict[str, dict], results: stores.Store | None = None) -> dict[str, dict[str, DataFrame]]:
    """Run analyses (options by name) over a corpus; with a store their reports are written as files, by folder."""
    unknown = set(wanted) - set(REGISTRY)
    if unknown:
        raise ValueError(f"unknown analyses: {', '.join(sorted(unknown))}")
    for name, cls in REGISTRY.items():
        if name in wanted:
            task = cls(**wanted[name])
            corpus.results[name] = task.run(corpus)
            if results is not None:
                for folder, files in task.reports(corpus.results[name]).items():
                    results.write_each(files.select(F.concat(F.lit(f"{folder}/"), "subpath").alias("subpath"), "text"))
    return corpus.results
