"""A thin command line: pages in, results out.

    python -m weftline extract PAGES --what markdown --format json --out FOLDER
    python -m weftline validate RESULTS.json --schema SCHEMA.json --mode strict --out FOLDER
    python -m weftline template list FOLDER
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators import audit, chunking, dom, markdown, preprocess, records, represent
from weftline.sources import files

#: What can be extracted from pages (page_id, url, html).
VIEWS = {
    "markdown": markdown.markdown, "text": preprocess.html_to_text, "main": preprocess.main_content_html, "clean": preprocess.remove_boilerplate,
    "representations": represent.represent, "elements": lambda p: dom.elements(dom.dom_nodes(p)), "metadata": lambda p: represent.page_metadata(dom.dom_nodes(p)),
    "audit": lambda p: audit.issues(dom.dom_nodes(p)), "scores": lambda p: audit.scores(p, audit.issues(dom.dom_nodes(p))),
}


def view(pages: DataFrame, what: str, options: chunking.Options) -> DataFrame:
    return chunking.chunk(pages, options) if what == "chunks" else VIEWS[what](pages)


def check(rows: DataFrame, schema: dict, mode: str) -> DataFrame:
    """Rows of JSON texts (column value) with their errors."""
    parsed = rows.withColumn("record", F.from_json("value", records.struct_of(schema)))
    errors = F.when(F.expr("try_parse_json(value) is null"), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(*records.schema_errors(schema, F.col("record")))))
    out = parsed.select("value", errors.alias("errors"))
    return out.withColumn("is_valid", F.size("errors") == 0 if mode == "strict" else F.lit(True))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", help="JSON file of settings")
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract")
    extract.add_argument("source")
    extract.add_argument("--what", choices=[*VIEWS, "chunks"], default="markdown")
    extract.add_argument("--strategy", default=None)
    validate = commands.add_parser("validate")
    validate.add_argument("source")
    validate.add_argument("--schema", required=True)
    validate.add_argument("--mode", choices=["strict", "lenient", "none"], default=None)
    for command in (extract, validate):
        command.add_argument("--format", default="json")
        command.add_argument("--out", required=True)
    template = commands.add_parser("template")
    template.add_argument("action", choices=["create", "list"])
    template.add_argument("folder")
    template.add_argument("--name", default="")
    template.add_argument("--instruction", default="")
    args = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("weftline").getOrCreate()
    settings = files.load_config(spark.read.text(args.config, wholetext=True).first().value if args.config else None)
    if args.command == "extract":
        own = settings.chunking
        options = chunking.Options(chunking.strategy_of(args.strategy or own.strategy), own.max_tokens, own.min_tokens, own.overlap)
        files.write(view(files.read_pages(spark, args.source), args.what, options), args.out, args.format)
    elif args.command == "validate":
        schema = json.loads(spark.read.text(args.schema, wholetext=True).first().value)
        files.write(check(spark.read.text(args.source), schema, args.mode or settings.validation.mode), args.out, args.format)
    elif args.action == "create":
        files.save_template(spark, args.folder, args.name, args.instruction)
    else:
        files.templates(spark, args.folder).show(truncate=False)


if __name__ == "__main__":
    main()
