"""The command line: index, search, init-config, calibrate-thresholds, check-model, install-model, serve."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from lodestone.config import load_config
from lodestone.functions.vectors import HASH_MODEL, ModelNotCachedError, load_embedder
from lodestone.operators.retrieval import RANKED
from lodestone.plans import calibrate, hybrid, model_check, wizard
from lodestone.store import Index

COMMANDS = ("index", "init-config", "calibrate-thresholds", "check-model", "install-model", "serve")


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lodestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # workers need the package too, wherever this was started
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lodestone"), "zip", home, "lodestone"))
    return spark


def _parser(name: str) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog=f"lodestone {name}".strip())
    parser.add_argument("--root", default=os.environ.get("LODESTONE_ROOT", "."))
    parser.add_argument("--model", default=os.environ.get("LODESTONE_MODEL", HASH_MODEL))
    return parser


def _opened(args: argparse.Namespace) -> Index:
    """The index to read; exits if there is none, warns if it is stale."""
    index = Index(session(), os.path.abspath(args.root), args.model)
    if not index.exists():
        sys.exit(f"no index in {index.home}: run `lodestone index` first")
    notice = index.notice()
    for line in [*([notice] if notice else []), *index.warnings(load_config(index.root))]:
        print(f"warning: {line}", file=sys.stderr)
    return index


def _search(argv: list[str]) -> None:
    parser = _parser("")
    parser.add_argument("query")
    parser.add_argument("--k", type=int, default=3)
    parser.add_argument("--no-expand", action="store_true")
    args = parser.parse_args(argv)
    index = _opened(args)
    print(hybrid.render(args.query, hybrid.search_hybrid(index, args.query, load_config(index.root), args.k, expand=not args.no_expand)))


def _index(argv: list[str]) -> None:
    parser = _parser("index")
    parser.add_argument("subdir", nargs="?", default=os.environ.get("LODESTONE_SUBDIR", ""))
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    root = os.path.abspath(args.root)
    run = Index(session(), root, args.model).update(load_config(root), args.subdir, args.force)
    print(f"changed={run.changed_files} unchanged={run.unchanged_files} deleted={run.deleted_files} new_chunks={run.new_chunks} rewritten={run.rewritten_buckets}/{run.buckets}")
    for error in run.parse_errors[:20]:
        print(f"  {error}")


def _init_config(argv: list[str]) -> None:
    args = _parser("init-config").parse_args(argv)
    draft = wizard.suggest_config(wizard.list_tree(session(), os.path.abspath(args.root)))
    print(json.dumps(draft, indent=2, ensure_ascii=False))
    written = wizard.write_draft(args.root, draft)
    print(f"written to {written}: review it" if written else "there is a configuration already: not overwritten", file=sys.stderr)


def _calibrate(argv: list[str]) -> None:
    parser = _parser("calibrate-thresholds")
    parser.add_argument("--sample", type=int, default=calibrate.SAMPLE)
    args = parser.parse_args(argv)
    index = _opened(args)
    print(calibrate.report(index, load_config(index.root), args.sample))


def _check_model(argv: list[str]) -> None:
    parser = _parser("check-model")
    parser.add_argument("--file", action="append", required=True, dest="files", help="a file to chunk and embed, relative to the root; may be given again")
    parser.add_argument("--query-comment-lang", required=True, help="the question in the language of the comments")
    parser.add_argument("--query-code-lang", required=True, help="the same question in the language of the code")
    parser.add_argument("--top", type=int, default=RANKED)
    args = parser.parse_args(argv)
    questions = {"query_comment_lang": args.query_comment_lang, "query_code_lang": args.query_code_lang}
    rows = model_check.ranked_chunks(session(), os.path.abspath(args.root), args.files, list(questions.values()), args.model, args.top).collect()
    if not rows:
        sys.exit("no chunks in the given files")
    print(model_check.report(rows, questions, args.model))


def _install_model(argv: list[str]) -> None:
    args = _parser("install-model").parse_args(argv)
    try:
        load_embedder(args.model)
    except ModelNotCachedError:
        sys.exit(f"{args.model} is not on this machine: nothing is downloaded; put its tokenizer.json and model.onnx into a folder of that name below LODESTONE_MODELS")
    print(f"{args.model} is ready")


def _serve(argv: list[str]) -> None:
    from lodestone.server import serve

    args = _parser("serve").parse_args(argv)
    serve(session(), os.path.abspath(args.root), args.model)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    run = dict(zip(COMMANDS, (_index, _init_config, _calibrate, _check_model, _install_model, _serve), strict=True))
    if not argv:
        sys.exit("usage: lodestone QUERY | -- QUERY | " + " | ".join(COMMANDS))
    if argv[0] == "--":
        _search(argv[1:])
    else:
        run[argv[0]](argv[1:]) if argv[0] in run else _search(argv)


if __name__ == "__main__":
    main()
