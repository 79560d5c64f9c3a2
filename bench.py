"""Wall seconds of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs
three times and the best counts, so that JVM start-up is not measured.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lexmill.functions.cleaning import clean_text  # noqa: E402
from lexmill.operators import audit, batches, bpe, corpus, encoding, training_log, vocabulary  # noqa: E402
from lexmill.plans import text_queries  # noqa: E402
from lexmill.plans.inputs import marked_up, step_metrics  # noqa: E402
from lexmill.session import new_shared_path  # noqa: E402
from lexmill.sources.articles import read_jsonl_articles  # noqa: E402
from lexmill.sources.sequences import read_sequences, write_splits  # noqa: E402
from lexmill.sources.tables import read_table  # noqa: E402
from lexmill.sources.wiki_dump import read_wiki_dump  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
VOCAB_SIZE = 1_000


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    documents = read_table(spark, SF_DIR, "documents")
    made = {}

    def train():
        made["tokenizer"] = bpe.train_bpe(documents, VOCAB_SIZE)

    def encode():
        run(encoding.encode(documents.select("doc_id", "text"), made["tokenizer"]).select("doc_id", "ids"))

    def build():
        made["path"] = new_shared_path(spark, "sequences")
        encoded = encoding.encode(documents.select("doc_id", "text"), made["tokenizer"], ids="tokens").drop("text")
        write_splits(corpus.split_corpus(corpus.truncate_tokens(encoded), "doc_id"), made["path"])

    def collate():
        train_rows = batches.filter_short(read_sequences(spark, made["path"], "train"), count="token_count")
        run(batches.collate(batches.shuffle_rows(train_rows, "doc_id", epoch=0)))

    made["extracted"] = new_shared_path(spark, "extracted")
    lines = documents.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("title"), "text")), "source")
    lines.write.partitionBy("source").text(made["extracted"])
    made["dump"] = new_shared_path(spark, "dump")
    page = F.concat(
        F.lit("<page><title>"), F.col("doc_id").cast("string"), F.lit("</title><ns>0</ns><id>"), F.col("doc_id").cast("string"),
        F.lit("</id><revision><id>1</id><text>"), F.translate("text", "<>&", "   "), F.lit("</text></revision></page>"),
    )
    documents.select(page).write.option("compression", "bzip2").text(made["dump"])
    articles = documents.select(F.concat_ws("/", "source", "lang").alias("file"), F.col("source").alias("folder"))
    queries = {
        "clean_text": lambda: run(documents.select("doc_id", clean_text(marked_up()).alias("text"))),
        "jsonl_articles": lambda: run(read_jsonl_articles(spark, made["extracted"])),
        "wiki_articles": lambda: run(read_wiki_dump(spark, made["dump"])),
        "pretokenize": lambda: run(text_queries.QUERIES["pretokenize"](spark, SF_DIR)),
        "word_counts": lambda: run(vocabulary.word_counts(documents)),
        "train_bpe": train,
        "encode": encode,
        "decode": lambda: run(
            encoding.decode(read_sequences(spark, made["path"]), made["tokenizer"].vocab, "tokens").select("decoded")
        ),
        "build_corpus": build,
        "corpus_stats": lambda: run(corpus.corpus_stats(read_sequences(spark, made["path"]))),
        "collate": collate,
        "rank_files": lambda: run(audit.rank_files(audit.file_counts(articles))),
        "rolling_loss": lambda: run(training_log.rolling_loss(step_metrics(spark, SF_DIR))),
    }
    order = sorted(queries, key=lambda name: name in ("decode",))  # decode reads what build_corpus wrote
    seconds = {}
    for name in order:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name]()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
