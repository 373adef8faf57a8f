"""The engine behind HTTP, as a WSGI application: python -m skerry serve FOLDER [PORT]."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable
from http import HTTPStatus
from socketserver import ThreadingMixIn
from urllib.parse import parse_qs
from wsgiref.simple_server import WSGIServer, make_server

from .engine import SearchEngine, TooManyRequests, Unauthorised

log = logging.getLogger("skerry.http")

#: Pages of these origins may call the service.
ORIGINS = ("http://localhost:5173", "http://127.0.0.1:5173")

#: What an error of the engine is to a client; the first that fits holds.
STATUS = ((TooManyRequests, HTTPStatus.TOO_MANY_REQUESTS), (Unauthorised, HTTPStatus.UNAUTHORIZED), (FileNotFoundError, HTTPStatus.NOT_FOUND), (ValueError, HTTPStatus.UNPROCESSABLE_ENTITY))


class Request:
    """The parameters of a request; one that is missing without a default, or is no number where one is needed, is a ValueError."""

    def __init__(self, environ: dict):
        self.values = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", ""), keep_blank_values=True).items()}
        self.key = environ.get("HTTP_X_API_KEY")
        self.client = environ.get("REMOTE_ADDR") or "unknown"

    def text(self, name: str, default: str | None = None, needed: bool = False) -> str | None:
        if needed and name not in self.values:
            raise ValueError(f"{name} is needed")
        return self.values.get(name, default)

    def number(self, name: str, default: int) -> int:
        value = self.values.get(name, default)
        try:
            return int(value)
        except ValueError:
            raise ValueError(f"{name} must be a whole number") from None


def routes(engine: SearchEngine) -> dict[tuple[str, str], Callable[[Request], dict]]:
    return {
        ("GET", "/health"): lambda r: engine.get_health(),
        ("GET", "/search"): lambda r: engine.get_search(r.text("q", needed=True), r.text("source_type"), r.number("top_k", 10), r.key, r.client),
        ("GET", "/suggest"): lambda r: engine.get_suggest(r.text("prefix", needed=True), r.number("limit", 10), r.client),
        ("POST", "/index"): lambda r: engine.post_index(r.text("directory", needed=True), r.key),
        ("GET", "/stats"): lambda r: engine.get_stats(),
        ("GET", "/history"): lambda r: engine.get_history(r.key, r.number("limit", 50)),
        ("GET", "/analytics"): lambda r: engine.get_analytics(r.key),
    }


def answer(table: dict, environ: dict) -> tuple[HTTPStatus, dict]:
    """(status, body) of a request."""
    method, path = environ["REQUEST_METHOD"], environ.get("PATH_INFO") or "/"
    handler = table.get((method, path))
    if handler is None:
        other = any(p == path for _, p in table)
        status = HTTPStatus.METHOD_NOT_ALLOWED if other else HTTPStatus.NOT_FOUND
        return status, {"detail": status.phrase}
    try:
        return HTTPStatus.OK, handler(Request(environ))
    except Exception as e:  # noqa: BLE001  every failure is an answer
        for kind, status in STATUS:
            if isinstance(e, kind):
                return status, {"detail": str(e)}
        log.exception("%s %s", method, path)
        return HTTPStatus.INTERNAL_SERVER_ERROR, {"detail": "internal error"}


def create_app(engine: SearchEngine, origins: Iterable[str] = ORIGINS):
    """The application: JSON answers, a log line a request, and the headers that let pages of `origins` call it."""
    table, allowed = routes(engine), frozenset(origins)

    def app(environ: dict, start_response) -> list[bytes]:
        began = time.perf_counter()
        origin = environ.get("HTTP_ORIGIN")
        headers = [("Content-Type", "application/json; charset=utf-8")]
        if origin in allowed:
            headers += [("Access-Control-Allow-Origin", origin), ("Vary", "Origin")]
        if environ["REQUEST_METHOD"] == "OPTIONS":
            status, body = HTTPStatus.NO_CONTENT, b""
            if origin in allowed:
                headers += [("Access-Control-Allow-Methods", "GET, POST"), ("Access-Control-Allow-Headers", environ.get("HTTP_ACCESS_CONTROL_REQUEST_HEADERS") or "*")]
        else:
            status, found = answer(table, environ)
            body = json.dumps(found, ensure_ascii=False, default=str).encode()
        headers.append(("Content-Length", str(len(body))))
        start_response(f"{status.value} {status.phrase}", headers)
        log.info("%s %s -> %d (%.2f ms)", environ["REQUEST_METHOD"], environ.get("PATH_INFO"), status, 1000 * (time.perf_counter() - began))
        return [body]

    return app


class _Server(ThreadingMixIn, WSGIServer):
    daemon_threads = True


def serve(engine: SearchEngine, host: str = "127.0.0.1", port: int = 8000) -> None:
    """Answer requests, each in a thread of its own, until interrupted."""
    with make_server(host, port, create_app(engine), server_class=_Server) as server:
        server.serve_forever()
