"""A thin HTTP service over a catalog."""

from __future__ import annotations

import argparse
import json
import logging
import mimetypes
import os
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .catalog import Catalog, iterate_rows, json_chunks
from .sources.config import Config, load_config
from .sources.samples import register_samples

MAX_REQUEST, MAX_UPLOAD = 10 << 20, 50 << 20


def prepare(spark: SparkSession, config: Config) -> Catalog:
    """A catalog with the sample and the configured datasets; one that cannot be read is logged and left out."""
    catalog = Catalog(spark)
    if config.enable_samples:
        register_samples(catalog)
    for d in config.datasets:
        try:
            catalog.register_file(d.name, d.file, d.xsd_file or None)
        except Exception:
            logging.getLogger("nestql").exception("dataset %s was not loaded", d.name)
    return catalog


class Handler(BaseHTTPRequestHandler):
    catalog: Catalog
    config: Config

    def log_message(self, *args) -> None:
        if self.config.log_requests:
            super().log_message(*args)

    def _send(self, body: str | bytes, status: int = 200, kind: str = "application/json") -> None:
        data = body.encode() if isinstance(body, str) else body
        self._head(status, kind, len(data))
        self.wfile.write(data)

    def _head(self, status: int, kind: str, size: int | None) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        if size is not None:
            self.send_header("Content-Length", str(size))
        for name, value in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "Content-Type")):
            self.send_header(f"Access-Control-Allow-{name}", value)
        self.end_headers()

    def _stream(self, chunks: Iterator[str]) -> None:
        """Send a body as it is made; it ends where the connection does. Only what fails before the first chunk has a status."""
        chunk = next(chunks)
        self._head(200, "application/json", None)
        self.close_connection = True
        try:
            self.wfile.write(chunk.encode())
            for chunk in chunks:
                self.wfile.write(chunk.encode())
        except Exception:
            logging.getLogger("nestql").exception("the answer to %s was cut off", self.path)

    def _fail(self, status: int, what: object) -> None:
        self._send(json.dumps({"error": str(what)}), status)

    def _body(self, most: int) -> bytes:
        size = int(self.headers.get("Content-Length") or 0)
        if size > most:
            raise ValueError(f"the body is over {most} bytes")
        return self.rfile.read(size)

    def do_OPTIONS(self) -> None:
        self._send(b"", 204)

    def do_GET(self) -> None:
        url = urlsplit(self.path)
        name = (parse_qs(url.query).get("dataset") or [""])[0]
        try:
            if url.path == "/api/datasets":
                self._send(json.dumps(self.catalog.names()))
            elif url.path == "/api/schema":
                fields = [{"path": f.path, "type": f.type, **({"arrayPath": f.array_path} if f.array_path else {})} for f in self.catalog.schema(name)]
                self._send(json.dumps(fields))
            elif url.path == "/api/data":
                rows = self.catalog.rows(name).toLocalIterator() if self.catalog.get(name) is not None else ()
                self._stream(json_chunks(r.value for r in rows))
            elif url.path in ("/api/xsd", "/api/xsd/info"):
                hints = self.catalog.hints(name)
                self._send(json.dumps({"dataset": name, "stringPaths": sorted(hints.text_paths), "arrayPaths": sorted(hints.array_paths)}))
            elif url.path in ("/api/aggregate", "/api/upload", "/api/upload/xsd"):
                self._fail(405, "use POST")
            else:
                self._static(url.path)
        except Exception as e:
            self._fail(400, e)

    def _static(self, path: str) -> None:
        top = os.path.realpath(self.config.static_dir)
        file = os.path.realpath(os.path.join(top, path.lstrip("/") or "index.html"))
        if not file.startswith(top + os.sep) or not os.path.isfile(file):
            self._fail(404, "not found")
            return
        with open(file, "rb") as f:
            self._send(f.read(), kind=mimetypes.guess_type(file)[0] or "application/octet-stream")

    def do_POST(self) -> None:
        url = urlsplit(self.path)
        name = (parse_qs(url.query).get("dataset") or [""])[0]
        try:
            if url.path == "/api/aggregate":
                found = self.catalog.aggregate(self._body(MAX_REQUEST).decode())
                self._stream(json_chunks(json.dumps(r, ensure_ascii=False) for r in iterate_rows(found)))
            elif url.path == "/api/upload":
                name = self.catalog.upload(self._body(MAX_UPLOAD), self.headers.get("Content-Type") or "", name or None)
                self._send(json.dumps({"dataset": name, "records": self.catalog.get(name).count()}))
            elif url.path == "/api/upload/xsd":
                hints = self.catalog.register_xsd(name, self._body(MAX_UPLOAD))
                self._send(json.dumps({"dataset": name, "stringPaths": sorted(hints.text_paths), "arrayPaths": sorted(hints.array_paths)}))
            else:
                self._fail(405 if url.path.startswith("/api/") else 404, "no such operation")
        except Exception as e:
            self._fail(400, e)


def serve(spark: SparkSession, config: Config) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""
    bound = type("BoundHandler", (Handler,), {"catalog": prepare(spark, config), "config": config})
    return ThreadingHTTPServer(("", int(config.port)), bound)


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--config", default="config.yaml")
    config = load_config(options.parse_args().config)
    serve(SparkSession.builder.appName("nestql").getOrCreate(), config).serve_forever()


if __name__ == "__main__":
    main()
