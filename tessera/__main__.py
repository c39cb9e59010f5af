"""Command line: ``python -m tessera encode|train|words|stages|manifest``, over newline or hex corpora; see ``--help``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encode as enc
from .operators import train as tr
from .operators import words as wd
from .plans.model import load_model, save_model
from .sources import corpus
from .sources.ids import write_ids


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, model: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=what)
        p.add_argument("corpus", help="a file or folder that Spark can read")
        p.add_argument("--hex", action="store_true", help="a document a line in hex, not as text")
        if model:
            p.add_argument("--model", required=True, help="tokenizer.json")
        return p

    p = command("encode", "ids of every document, and a summary", True)
    p.add_argument("--out", help="a folder for lines of ids, in the order of documents; without it only the summary is printed")
    p = command("train", "train merge rules and write a model")
    p.add_argument("--vocab-size", type=int, required=True)
    p.add_argument("--special", action="append", default=[])
    p.add_argument("--mode", choices=("canonical", "reference"), default="canonical")
    p.add_argument("--out", required=True, help="the tokenizer.json to write")
    p = command("words", "counts of words of up to 15 bytes")
    p.add_argument("--top", type=int, default=0, help="also print so many of the most frequent words")
    p = command("stages", "what each stage makes of every document", True)
    p.add_argument("--limit", type=int, default=100, help="rows to print")
    p = command("manifest", "documents and bytes of each file and in all")
    p.add_argument("--out", help="a folder for the JSON")
    return top.parse_args(given)


def read(spark: SparkSession, path: str, hexed: bool) -> DataFrame:
    """``doc_id`` from 0, ``text`` binary: what stands between newlines, or the bytes of hex lines (null for a bad one)."""
    found = corpus.read_hex_corpus(spark, path) if hexed else corpus.read_documents(spark, path)
    return found.select("doc_id", F.col("content").alias("text"))


def _shown(row) -> dict:
    """A row as JSON has it: bytes with what doesn't print as ``\\xNN``."""
    return {k: wd.shown(bytes(v)) if isinstance(v, (bytes, bytearray)) else v for k, v in row.asDict().items()}


def run(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """What a command prints, a JSON object a line."""
    if a.command == "manifest":
        found = corpus.read_hex_corpus(spark, a.corpus) if a.hex else corpus.read_documents(spark, a.corpus)
        made = corpus.manifest_json(found, "file", "content")
        if a.out:
            made.coalesce(1).write.text(a.out)
        return [json.loads(made.first()["json"])]
    docs, began = read(spark, a.corpus, a.hex), time.time()
    if a.command == "train":
        model = tr.train(docs, a.vocab_size, tuple(a.special), a.mode)
        save_model(spark, model, a.out)
        return [{"vocab_size": model.vocab_size, "merges": len(model.merges), "seconds": round(time.time() - began, 3)}]
    if a.command == "words":
        top = wd.word_count(docs, most_bytes=wd.MOST_BYTES).orderBy(F.desc("n"), "piece").limit(a.top).collect() if a.top else []
        return [wd.word_stats(docs).first().asDict(), *map(_shown, top)]
    model = load_model(spark, a.model)
    if a.command == "stages":
        return [r.asDict() for r in enc.explain_stages(docs, model).orderBy("doc_id", "pos", "sym_pos").limit(a.limit).collect()]
    done = write_ids(docs, model, a.out)
    seconds = time.time() - began
    return [done | {"rc": 11 if done["misses"] else 1 if done["bad"] else 0, "seconds": round(seconds, 3), "mb_per_s": round(done["bytes"] / 1e6 / seconds, 2)}]


def main(given: list[str] | None = None) -> int:
    a = arguments(given)
    spark = SparkSession.builder.appName(f"tessera {a.command}").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for row in run(spark, a):
        print(json.dumps(row, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
