"""Command line: encode, decode, count, chat, info, list-encodings, list-models, version."""

from __future__ import annotations

import argparse
import json
import sys
import time

from . import __version__, encoding_for_model, get_encoding, list_encoding_names
from .encoding import Encoding
from .registry import list_models
from .sources.ranks import parse_blob, parse_ranks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexspan")
    p.add_argument("command", choices=["encode", "decode", "count", "chat", "info", "bench", "list-encodings", "list-models", "version"])
    p.add_argument("text", nargs="*", help="the text, or ids; '-' or nothing reads standard input")
    p.add_argument("-e", "--encoding", default="o200k_base")
    p.add_argument("-m", "--model")
    p.add_argument("-f", "--file")
    p.add_argument("--rank-file")
    p.add_argument("--json", action="store_true")
    p.add_argument("--no-download", action="store_true", help="nothing is ever downloaded")
    a = p.parse_args(argv)
    show = lambda x, plain: print(json.dumps(x) if a.json else plain)
    if a.command == "version":
        show({"version": __version__}, __version__)
    elif a.command == "list-encodings":
        show(list_encoding_names(), "\n".join(list_encoding_names()))
    elif a.command == "list-models":
        show(list_models(), "\n".join(list_models()))
    elif a.command == "info":
        import pyspark

        print(json.dumps({"version": __version__, "python": sys.version.split()[0], "pyspark": pyspark.__version__, "backend": "spark"}))
    else:
        enc = encoding_for_model(a.model) if a.model else get_encoding(a.encoding)
        if a.rank_file:
            with open(a.rank_file, "rb") as f:
                payload = f.read()
            ranks = parse_blob(payload) if payload.startswith(b"TTKRBIN1") else parse_ranks(payload)
            enc = Encoding(enc.name, pat_str=enc._pat_str, mergeable_ranks=ranks, special_tokens=enc._special_tokens)
        if a.file:
            with open(a.file, encoding="utf-8") as f:
                text = f.read()
        else:
            text = sys.stdin.read() if not a.text or a.text == ["-"] else " ".join(a.text)
        if a.command == "encode":
            print(json.dumps(enc.encode(text)))
        elif a.command == "count":
            n = enc.count(text)
            show({"count": n}, n)
        elif a.command == "decode":
            got = enc.decode([int(x) for x in text.replace(",", " ").replace("[", " ").replace("]", " ").split()])
            show(got, got)
        elif a.command == "chat":
            n = enc.count_chat(json.loads(text))
            show({"count": n}, n)
        else:
            t = time.perf_counter()
            n = enc.count(text)
            print(json.dumps({"tokens": n, "seconds": time.perf_counter() - t}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
