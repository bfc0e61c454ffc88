"""The service over HTTP: GET /health, /stats, /exact, /search; POST /search/bulk. Any origin may ask; requests are logged."""

from __future__ import annotations

import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .operators.normalize import InvalidDomain
from .service import BadRequest, Service
from .sources.requests import DEFAULT_LIMIT

log = logging.getLogger(__name__)
CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "*", "Access-Control-Allow-Headers": "*"}


def answer(service: Service, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON value of a request."""
    parts = urlsplit(target)
    asked = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    number = lambda source, key, default: default if source.get(key) is None else int(source[key])
    try:
        match method, parts.path:
            case "GET", "/health":
                return 200, service.health()
            case "GET", "/stats":
                return 200, service.stats()
            case "GET", "/exact":
                return 200, service.exact(asked["domain"])
            case "GET", "/search":
                return 200, service.search(asked["q"], asked.get("tld"), number(asked, "limit", DEFAULT_LIMIT), number(asked, "min_match", None))
            case "POST", "/search/bulk":
                sent = json.loads(body)
                return 200, service.search_bulk(sent["queries"], number(sent, "limit", DEFAULT_LIMIT))
        return 404, {"error": "no such resource"}
    except KeyError as e:
        return 400, {"error": f"missing: {e.args[0]}"}
    except (BadRequest, InvalidDomain, ValueError, TypeError) as e:
        return 400, {"error": str(e)}


class Handler(BaseHTTPRequestHandler):
    service: Service

    def reply(self, method: str) -> None:
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        try:
            status, value = answer(self.service, method, self.path, body)
        except Exception:  # the caller learns that it failed, the log why
            log.exception("%s %s", method, self.path)
            status, value = 500, {"error": "internal error"}
        data = json.dumps(value).encode()
        self.send_response(status)
        for k, v in {"Content-Type": "application/json", "Content-Length": str(len(data)), **CORS}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        self.reply("GET")

    def do_POST(self) -> None:
        self.reply("POST")

    def do_OPTIONS(self) -> None:
        self.send_response(204)
        for k, v in CORS.items():
            self.send_header(k, v)
        self.end_headers()

    def log_message(self, format: str, *args) -> None:
        log.info(format, *args)


def server(service: Service, port: int = 3000, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"service": service}))
