"""Command line: ``python -m quarry build | query | ask | serve | mcp | vectors``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import SparkSession

from .agent import mcp, models, server
from .agent.loop import answer
from .agent.tools import Searches, format_chunks, registry
from .functions import embedders
from .operators import documents as D
from .operators.vector_index import VectorIndex
from .plans import config as C
from .plans import index as I

FOLDER = ".quarry"
MODES = ("hybrid", "fts", "literal", "vector", "grep")


def session() -> SparkSession:
    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry")
    commands = top.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="build an index, or bring it up to date")
    b.add_argument("-c", "--content", help="folder of the documents")
    b.add_argument("-r", "--root", help="folder of the project")
    b.add_argument("-o", "--out")
    b.add_argument("-f", "--filter", action="append", default=[], metavar="FIELD=VALUE")
    b.add_argument("--embedding-model")
    b.add_argument("--embedding-dim", type=int)
    b.add_argument("--max-tokens", type=int)
    b.add_argument("--overlap", type=int)
    for flag in ("clean", "include-drafts", "copy-content"):
        b.add_argument(f"--{flag}", action="store_true")
    q = commands.add_parser("query", help="search an index")
    q.add_argument("text", nargs="?", help="without one, a search for each line of standard input; :fts and the like change the mode")
    q.add_argument("--mode", choices=MODES, default="hybrid")
    q.add_argument("-k", type=int, default=10)
    a = commands.add_parser("ask", help="have a language model answer")
    a.add_argument("question")
    s = commands.add_parser("serve", help="answer over HTTP")
    s.add_argument("--port", type=int, default=3000)
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--examples")
    s.add_argument("--content")
    s.add_argument("--log-days", type=int, default=7, help="days after which logs of conversations go, unless reported")
    m = commands.add_parser("mcp", help="offer the tools to another program over standard input and output")
    for p in (q, a, s, m):
        p.add_argument("--index", default=FOLDER)
    for p in (a, s):
        p.add_argument("--model")
        p.add_argument("--max-iterations", type=int)
    v = commands.add_parser("vectors", help="work on a vector index")
    v.add_argument("--dir", default=".quarry-vectors")
    actions = v.add_subparsers(dest="action", required=True)
    each = {n: actions.add_parser(n) for n in ("create", "info", "insert", "upsert", "query", "get-by-ids", "delete-by-ids", "list-vectors", "create-metadata-index", "delete-metadata-index", "list-metadata-index")}
    for p in each.values():
        p.add_argument("name")
    each["create"].add_argument("--dimensions", type=int, required=True)
    each["create"].add_argument("--metric", choices=("cosine", "euclidean", "dot-product"), default="cosine")
    for n in ("insert", "upsert"):
        each[n].add_argument("--file", required=True, help="a JSON object a line")
    q = each["query"]
    q.add_argument("--vector", help="JSON array, or @file")
    q.add_argument("--vector-id")
    q.add_argument("--top-k", type=int)
    q.add_argument("--namespace")
    q.add_argument("--filter", type=json.loads)
    q.add_argument("--return-values", action="store_true")
    q.add_argument("--return-metadata", choices=("none", "indexed", "all"), default="none")
    for n in ("get-by-ids", "delete-by-ids"):
        each[n].add_argument("--ids", required=True)
    each["list-vectors"].add_argument("--count", type=int)
    each["list-vectors"].add_argument("--cursor")
    for n in ("create-metadata-index", "delete-metadata-index"):
        each[n].add_argument("--property-name", required=True)
    each["create-metadata-index"].add_argument("--type", required=True)
    return top


def build(spark: SparkSession, args) -> dict:
    config, _ = C.project(os.getcwd())
    root = Path(args.root) if args.root else C.content_root(config, os.getcwd())
    content = args.content or str(root / config["content"]["dir"])
    folder = args.out or str(root / FOLDER)
    for name, given in (("maxTokens", args.max_tokens), ("overlap", args.overlap)):
        if given is not None:
            config["chunking"] = config["chunking"] | {name: given}
    before = None if args.clean else I.opened(spark, folder)
    model = args.embedding_model or (before.manifest["embedding"]["model_id"] if before else (config.get("embedding") or {}).get("model", "mock"))
    dimension = embedders.dimension_of(model, args.embedding_dim)
    say = lambda line: print(line, file=sys.stderr)
    found = "clean" if args.clean else I.state(spark, folder)
    say({"clean": "building anew", "complete": "bringing the index up to date", "partial": "resuming a build that stopped", "none": "building a first index"}[found])
    made = I.build(
        spark, content, folder, config, embedders.as_column(model, dimension), model, dimension,
        active=C.parse_filter(args.filter), drafts=args.include_drafts, clean=args.clean, content_copy=args.copy_content, report=say,
    )
    return made.manifest


def opened(spark: SparkSession, folder: str):
    """The index and the function that embeds queries with its model."""
    index = I.opened(spark, folder)
    if index is None:
        raise ValueError(f"there is no index in {folder}")
    own = index.manifest["embedding"]
    return index, embedders.for_queries(spark, own["model_id"], own["dimension"])


def asking(index, args) -> tuple:
    agent = index.manifest.get("agent") or {}
    return models.by_name(args.model or agent.get("model") or "llama3.2"), args.max_iterations or agent.get("max_iterations") or 5, agent.get("system_prompt")


def search(index, embed, mode: str, text: str, k: int) -> str:
    """The results of one search as text."""
    if mode == "grep":
        if not index.has_lines:
            raise ValueError("the index was built without --copy-content")
        try:
            index.spark.sparkContext._jvm.java.util.regex.Pattern.compile(text)
        except IllegalArgumentException as e:
            raise ValueError(f"not a pattern: {text}") from e
        found = D.grep(index.table("lines"), text, files=k).collect()
        return "\n\n".join(f"{r.path} ({r.matches} matches)\n" + "\n".join(f"  {s.line_no}: {s.line}" for s in r.snippets) for r in found) or "No grep matches found."
    searches = Searches(index, embed)
    run = {"hybrid": searches.hybrid, "fts": searches.full_text, "literal": searches.literal, "vector": searches.vector}[mode]
    return format_chunks(run(text, k), index.manifest.get("base_url"))


def searching(index, embed, mode: str, lines, k: int) -> None:
    """A search for every line; a line such as ``:fts`` changes the mode, ``:quit`` ends."""
    for line in map(str.strip, lines):
        if line in (":quit", ":q"):
            return
        if line.removeprefix(":") in MODES and line.startswith(":"):
            mode = line[1:]
        elif line:
            try:
                print(search(index, embed, mode, line, k), end="\n\n", flush=True)
            except ValueError as e:
                print(f"quarry: {e}", file=sys.stderr)


def read_lines(path: str) -> list[dict]:
    """A JSON object a line; blank lines are skipped, and a bad line is named."""
    rows = []
    with open(path, encoding="utf-8") as lines:
        for n, line in enumerate(lines, 1):
            if line.strip():
                try:
                    rows.append(json.loads(line))
                except ValueError as e:
                    raise ValueError(f"{path}, line {n}: {e}") from e
    return rows


def numbers(text: str) -> list[float]:
    found = json.loads(Path(text[1:]).read_text(encoding="utf-8") if text.startswith("@") else text)
    if not isinstance(found, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in found):
        raise ValueError("a vector is an array of numbers")
    return found


def vectors(spark: SparkSession, args):
    folder = f"{args.dir}/{args.name}"
    if args.action == "create":
        return VectorIndex(spark, folder, args.dimensions, args.metric).describe()
    try:
        meta = json.loads(spark.read.text(f"{folder}/index.json", wholetext=True).first().value)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"there is no vector index in {folder}") from e
    index = VectorIndex(spark, folder, meta["dimensions"], meta["metric"])
    if args.action == "info":
        return index.describe()
    if args.action in ("insert", "upsert"):
        done = getattr(index, args.action)(read_lines(args.file))
        return {"mutation_id": done.mutation_id, "count": done.count, "ids": done.ids}
    if args.action == "query":
        options = {"top_k": args.top_k, "namespace": args.namespace, "filter": args.filter, "return_values": args.return_values, "return_metadata": args.return_metadata}
        if (args.vector is None) == (args.vector_id is None):
            raise ValueError("give either --vector or --vector-id")
        found = index.query_by_id(args.vector_id, **options) if args.vector is None else index.query(numbers(args.vector), **options)
        rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in found.collect()]
        return {"count": len(rows), "matches": rows}
    if args.action in ("get-by-ids", "delete-by-ids"):
        ids = [x.strip() for x in args.ids.split(",") if x.strip()]
        if args.action == "get-by-ids":
            return [r.asDict() for r in index.get_by_ids(ids).collect()]
        done = index.delete_by_ids(ids)
        return {"mutation_id": done.mutation_id, "count": done.count, "ids": done.ids}
    if args.action == "list-vectors":
        return index.list_vectors(args.count, args.cursor)
    if args.action == "create-metadata-index":
        index.create_metadata_index(args.property_name, args.type)
    elif args.action == "delete-metadata-index":
        index.delete_metadata_index(args.property_name)
    return dict(index.list_metadata_indexes())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    try:
        if args.command == "build":
            print(json.dumps(build(spark, args), indent=2))
        elif args.command == "vectors":
            print(json.dumps(vectors(spark, args), indent=2))
        else:
            index, embed = opened(spark, args.index)
            if args.command == "query":
                if args.text is None:
                    searching(index, embed, args.mode, sys.stdin, args.k)
                else:
                    print(search(index, embed, args.mode, args.text, args.k))
            elif args.command == "mcp":
                mcp.Server(index.manifest, registry(index, embed)).serve(sys.stdin, sys.stdout)
            elif args.command == "ask":
                model, most, prompt = asking(index, args)
                for event in answer(args.question, registry(index, embed), model, most, prompt):
                    if event["type"] in ("token", "error"):
                        print(event.get("content") or event.get("message"))
                    for r in event.get("references", []):
                        print(f"[{r['n']}] {r['badge'] + ' ' if 'badge' in r else ''}{' > '.join([r['title'], *(r['headings'] or [])])}\n    {r['url']}")
            else:
                model, most, prompt = asking(index, args)
                suggested = server.examples(args.examples) if args.examples else None
                made = server.server(index, registry(index, embed), model, args.port, args.host, most, prompt, suggested, args.content, server.Logs(f"{args.index}/debug", args.log_days))
                made.serve_forever()
    except (ValueError, OSError) as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
