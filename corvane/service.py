"""HTTP service: ``/info``, ``/corpus_info``, ``/query`` and ``/count`` as JSON, and a page to try them."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from corvane.api import Engine

PAGE = Path(__file__).with_name("page.html")
YES = ("1", "true", "yes", "on")


def answer(engine: Engine, path: str, asked: dict[str, str]) -> dict:
    """The result of one call; LookupError for a path or parameter that isn't there."""

    def need(name: str) -> str:
        if name not in asked:
            raise LookupError(f"missing parameter: {name}")
        return asked[name]

    number = lambda name, default: int(asked.get(name) or default)
    breaks = asked.get("no_sentence_breaks", "").lower() not in YES
    if asked.get("no_cache", "").lower() in YES:
        engine = Engine(engine.spark, engine.base_dir)
    plan = "arrays" if asked.get("no_binary", "").lower() in YES else None
    if path == "/info":
        return engine.info()
    if path == "/corpus_info":
        return engine.corpus_info(need("corpus"))
    if path == "/query":
        return engine.query(need("corpus"), need("cqp"), number("start", 0), number("num", 10), number("end", -1), asked.get("show", ""), breaks, plan)
    if path == "/count":
        return engine.count(need("corpus"), need("cqp"), need("group_by"), number("num", 10), number("sampling", 100_000), breaks, plan)
    raise LookupError(f"no such path: {path}")


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: bytes, kind: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path in ("/", "/webdemo"):
                self.reply(200, PAGE.read_bytes(), "text/html")
                return
            began = time.time()
            try:
                code, out = 200, answer(engine, url.path, {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()})
                out["time"] = time.time() - began
            except FileNotFoundError as e:
                code, out = 404, {"detail": str(e)}
            except LookupError as e:
                code, out = (404 if "path" in str(e) else 422), {"detail": str(e)}
            except Exception as e:
                code, out = 500, {"detail": str(e)}
            self.reply(code, json.dumps(out, ensure_ascii=False).encode(), "application/json")

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for k, v in (("Origin", "*"), ("Methods", "GET, OPTIONS"), ("Headers", "*")):
                self.send_header(f"Access-Control-Allow-{k}", v)
            self.end_headers()

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
