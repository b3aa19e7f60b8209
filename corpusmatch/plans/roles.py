"""The given tables in the roles of a corpus: files, symbols, patterns, vectors, generated sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmatch.functions import text as tx


# Paths given to the documents in turn, by document number.
PATHS = [
    "src/mod.py",
    "nb/cells.ipynb",
    "README.md",
    "docs/guide.md",
    "notes.txt",
    "conf/app.yaml",
    "Dockerfile",
    "requirements.txt",
    ".git/config.ini",
    "lib/core.rs",
    ".github/flow.yml",
    "settings.conf",
]


# Generated files of one task: a part is some bytes, but its file is written and parsed.
FILES_PER_TASK = 5_000


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def doc_files(self) -> DataFrame:
        """Documents as files: file = document, repository = its source."""
        path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
        rel_path = F.concat(F.lit("d"), F.col("doc_id"), F.lit("/"), path)
        return self.table("documents").select(
            F.col("doc_id").alias("file_id"), F.col("source").alias("repo_id"), rel_path.alias("rel_path"), "text"
        )

    def doc_contents(self) -> DataFrame:
        """The same as raw bytes below a root folder."""
        return self.doc_files().select(
            "file_id",
            "repo_id",
            F.concat(F.lit("/corpus/"), "repo_id", F.lit("/"), "rel_path").alias("path"),
            F.concat(F.lit("/corpus/"), "repo_id").alias("root"),
            F.col("text").cast("binary").alias("content"),
        )

    def doc_symbols(self) -> DataFrame:
        """Documents as symbols whose docstring and source are the whole text."""
        return self.table("documents").select(
            F.col("doc_id").alias("symbol_id"),
            F.col("doc_id").alias("file_id"),
            F.col("source").alias("repo_id"),
            F.lit("doc").alias("kind"),
            F.concat(F.lit("doc_"), "lang").alias("name"),
            F.col("text").alias("docstring"),
            F.col("text").alias("source"),
            F.lit(None).cast("array<float>").alias("embedding"),
        )

    def vector_symbols(self) -> DataFrame:
        """Document symbols with the vector of the same number; a number without a document is a nameless symbol."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("symbol_id"), "embedding")
        joined = self.doc_symbols().drop("embedding").join(vectors, "symbol_id", "full")
        return joined.withColumn("repo_id", F.coalesce("repo_id", F.lit("vectors")))

    def line_symbols(self) -> DataFrame:
        """The lines of the documents as symbols of their document."""
        lines = self.table("documents").select(
            F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "source")
        )
        return lines.withColumn("symbol_id", F.concat("file_id", F.lit(":"), "ordinal"))

    def item_patterns(self) -> DataFrame:
        """Benchmark items as patterns; the first three distinct long words of an item are its indicators."""
        words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))
        return self.table("benchmark").select(
            F.col("item_id").alias("pattern_id"),
            F.concat(F.lit("item_"), "item_id").alias("name"),
            F.col("text").alias("description"),
            F.slice(F.array_distinct(words), 1, 3).alias("indicators"),
        )

    def label_patterns(self) -> DataFrame:
        """The first vector of each label as a pattern.

        Of three labels in turn one has no indicators, one the first words of the item of that number
        (whatever they are), one that item's indicators.
        """
        firsts = self.table("embeddings").groupBy(F.col("label").cast("bigint").alias("pattern_id")).agg(
            F.min_by("embedding", "vec_id").alias("embedding")
        )
        words = F.slice(F.split(F.lower("description"), " "), 1, 3)
        turn = F.col("pattern_id") % 3
        indicators = (
            F.when(turn == 0, F.array().cast("array<string>")).when(turn == 1, words).otherwise(F.col("indicators"))
        )
        return firsts.join(self.item_patterns().drop("name"), "pattern_id", "left").select(
            "pattern_id",
            F.concat(F.lit("label_"), "pattern_id").alias("name"),
            indicators.alias("indicators"),
            "embedding",
        )

    def part_sources(self) -> DataFrame:
        """Python files generated from the parts; every tenth does not parse.

        The parts are dealt out by their number: millions of them are one small file, which would be a task or two.
        """
        parts = self.table("part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
        tasks = max(1, -(-parts.count() // FILES_PER_TASK))
        key = F.col("p_partkey").cast("string")
        text = F.concat(
            F.lit("@register\nclass Part"), key, F.lit(':\n    """'), "p_name", F.lit('\n\n      in stock\n    """\n'),
            F.lit("    def size(self, n, /, m, *args, unit='cm', **kw):\n        '''"), "p_type", F.lit("'''\n"),
            F.lit("        return "), F.col("p_size").cast("string"), F.lit("\n\n    class Inner:\n"),
            F.lit("        async def run(self): pass\n\n    if True:\n        def guarded(self, *, x): pass\n\n"),
            F.lit("def make_"), key, F.lit("(a, b=1):\n    def hidden(): pass\n    return '"), "p_brand", F.lit("\u00e9'\n"),
            F.when(F.col("p_partkey") % 10 == 0, "def broken(:\n").otherwise(""),
        )
        return parts.repartition(tasks).select(
            F.col("p_partkey").alias("file_id"),
            F.concat(F.lit("parts/p"), key, F.lit(".py")).alias("rel_path"),
            F.col("p_type").alias("repo_id"),
            F.lit("python").alias("lang"),
            text.alias("text"),
        )

    def turn_notebooks(self) -> DataFrame:
        """Each conversation turn as a notebook of four cells; every seventh conversation is not JSON."""

        def quoted(c: Column) -> Column:
            return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)

        text = F.concat(
            F.lit('{"cells":[{"cell_type":"'), F.when(F.col("role") == "assistant", "code").otherwise("markdown"),
            F.lit('","source":'), F.to_json(F.array(F.lit("# turn\n"), F.col("text"))),
            F.lit('},{"cell_type":"code","source":["  \\n",""]},{"cell_type":"raw","source":'), quoted(F.col("text")),
            F.lit('},{"source":'), quoted(F.to_json(F.array("role"))), F.lit('}],"nbformat":4}'),
            F.when(F.col("conv_id") % 7 == 0, "]").otherwise(""),
        )
        file_id = F.concat("conv_id", F.lit("-"), "turn")
        return self.table("conversations").select(
            file_id.alias("file_id"),
            F.concat(F.lit("chat"), F.col("conv_id") % 5).alias("repo_id"),
            F.concat(F.lit("nb/"), file_id, F.lit(".ipynb")).alias("rel_path"),
            F.lit("ipynb").alias("lang"),
            text.alias("text"),
        )

    def symbol_texts(self) -> DataFrame:
        """Embeddable texts of the document symbols: ``symbol_id, repo_id, text_hash, text, embedding``."""
        from corpusmatch.operators.embed import with_embedding_text

        due = with_embedding_text(self.doc_symbols(), tx.MIN_EMBED_CHARS, tx.MAX_BODY_CHARS).filter(F.col("text_hash").isNotNull())
        return due.select("symbol_id", "repo_id", "text_hash", "text", "embedding")

    def old_cache(self) -> DataFrame:
        """A cache that knows the texts of the even documents; the vector holds the first such number."""
        known = self.symbol_texts().filter(F.col("symbol_id") % 2 == 0)
        return known.groupBy("text_hash").agg(F.array(F.min("symbol_id").cast("float")).alias("embedding"))

    def repositories(self) -> DataFrame:
        """The document sources as repositories, all but one."""
        sources = self.table("documents").select(F.col("source").alias("repo_id")).distinct()
        return sources.filter(F.col("repo_id") != "src3").select(
            "repo_id",
            F.concat(F.lit("https://git.example.org/team/"), "repo_id", F.lit(".git")).alias("url"),
            F.concat(F.lit("name of "), "repo_id").alias("name"),
        )

    def sheet(self) -> DataFrame:
        """Benchmark items as a raw catalogue sheet with footnotes, repeated and blank names."""
        i = F.col("item_id")
        name = (
            F.when(i % 13 == 12, F.lit(" [3] "))
            .when(i % 4 == 0, F.concat(F.lit("  Item \t "), (i % 20).cast("string"), F.lit(" [12a]")))
            .otherwise(F.concat(F.lit("Item ( 3 ) "), (i % 20).cast("string"), F.lit("\u00a0")))
        )
        return self.table("benchmark").select(
            name.alias(" Pattern  Name"),
            F.concat(F.lit("\n"), "text", F.lit(" ")).alias("Description"),
            F.when(i % 3 == 0, F.lit(" why ")).alias("MOTIVATION"),
            F.concat(F.lit(" sub "), i.cast("string")).alias("SubCategory"),
            F.lit("first").alias("Link"),
            F.concat(F.lit("https://x.example/"), i.cast("string")).alias("URL"),
            F.lit("kept out").alias("Extra"),
            i.alias("item_id"),
        )


