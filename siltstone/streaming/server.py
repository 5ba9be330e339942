"""HTTP: POST /v1/logs takes OTLP requests, POST /v1/query runs SQL, GET /live and /ready tell the state."""

from __future__ import annotations

import json
import shutil
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import INGEST_BYTES, REQUEST_BYTES, RESPONSE_BYTES, Config, Unauthenticated
from ..operators import encode
from ..plans.engine import Engine, Limits, QueryError
from ..sources import frames, otlp
from ..sources.store import Store
from .ingest import Ingest
from .janitor import Janitor

#: HTTP status of each failure.
STATUS = {"unauthenticated": 401, "invalid_request": 400, "request_too_large": 400, "invalid_sql": 400, "timeout": 408, "busy": 429, "row_limit": 422, "response_too_large": 422, "unsupported_result_type": 422, "storage": 503, "resources": 503, "execution": 500}
PROTOBUF = "application/x-protobuf"
OPTIONS = {"sql", "timeout_ms", "max_rows"}


class Failure(Exception):
    def __init__(self, code: str, message: str = "", **more):
        super().__init__(message)
        self.code, self.more = code, more


class Service:
    """Everything a daemon runs: writers, stores, ingest, janitor, query engine."""

    def __init__(self, spark: SparkSession, config: Config, response_bytes: int = RESPONSE_BYTES, ingest_bytes: int = INGEST_BYTES):
        self.spark, self.config, self.response_bytes, self.ingest_bytes = spark, config, response_bytes, ingest_bytes
        tenants = sorted(set(config.tokens.tenants.values()))
        self.stores = {t: Store(spark, f"{config.data}/{t}", t) for t in tenants}
        self.writers = {t: frames.Writer(Path(config.frames) / t, t) for t in tenants}
        self.ingests = {t: Ingest(spark, str(Path(config.frames) / t), self.stores[t], config.max_dynamic_columns, config.max_depth, config.max_bytes) for t in tenants}
        self.engine = Engine(spark, Limits(config.timeout_ms / 1000, config.row_cap, config.concurrent))
        self.janitor = Janitor(config, self.stores)
        self.failed = False
        self.stopped = threading.Event()

    def accept(self, tenant: str, payload: bytes) -> int:
        received, stored = otlp.accept(payload, None, self.config.max_future_skew)
        return self.writers[tenant].append(received, stored)

    def publish_all(self) -> None:
        for ingest in self.ingests.values():
            ingest.run_once()

    def consume(self) -> None:
        """Publishes every poll interval until stopped, then what is left."""
        try:
            while not self.stopped.wait(self.config.poll_ms / 1000):
                self.publish_all()
            self.publish_all()
        except Exception:
            self.failed = True
            raise

    def ready(self) -> bool:
        return not self.failed and self.janitor.ready and shutil.disk_usage(self.config.frames).free >= self.config.min_free_bytes

    def query(self, tenant: str, body: bytes) -> bytes:
        if len(body) > REQUEST_BYTES:
            raise Failure("request_too_large", f"more than {REQUEST_BYTES} bytes")
        try:
            request = json.loads(body)
            sql, timeout, rows = request["sql"], request.get("timeout_ms"), request.get("max_rows")
            if set(request) - OPTIONS or not isinstance(sql, str) or any(x is not None and (type(x) is not int or x < 0) for x in (timeout, rows)) or rows == 0:
                raise ValueError
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise Failure("invalid_request", "not a query request") from e
        try:
            result = self.engine.query(self.stores[tenant], sql, None if timeout is None else timeout / 1000, rows, self.ingests[tenant].fresh)
            return encode.encode(result.schema, result.rows, result.shown, result.nullable, result.metrics, self.response_bytes)
        except QueryError as e:
            raise Failure(e.code, str(e)) from e
        except encode.TooLarge as e:
            raise Failure("response_too_large", str(e)) from e
        except encode.Unsupported as e:
            raise Failure("unsupported_result_type", str(e), data_type=e.data_type) from e

    def stop(self) -> None:
        self.janitor.stop()
        self.stopped.set()
        for writer in self.writers.values():
            writer.close()


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_) -> None:
            """Requests are not logged: they hold tokens and SQL."""

        def answer(self, status: int, body: bytes = b"", kind: str = "application/json", **headers: str) -> None:
            self.send_response(status)
            for name, value in ({"Content-Type": kind, "Content-Length": str(len(body)), "Access-Control-Allow-Origin": "*"} | headers).items():
                self.send_header(name.replace("_", "-"), value)
            self.end_headers()
            self.wfile.write(body)

        def fail(self, code: str, message: str = "", status: int | None = None, **more) -> None:
            headers = {"WWW_Authenticate": "Bearer"} if code == "unauthenticated" else {}
            self.close_connection = True
            self.answer(status or STATUS[code], json.dumps({"error": {"code": code, "message": message} | more}).encode(), **headers, Connection="close")

        def body(self, limit: int) -> bytes | None:
            """The body, or None if it is longer than the limit."""
            size = int(self.headers.get("Content-Length") or 0)
            return None if size > limit else self.rfile.read(size)

        def do_GET(self) -> None:
            if self.path == "/live":
                self.answer(200, b"ok", "text/plain")
            elif self.path == "/ready":
                good = service.ready()
                self.answer(200 if good else 503, b"ready" if good else b"not ready", "text/plain")
            else:
                self.answer(405 if self.path in ("/v1/logs", "/v1/query") else 404)

        def do_OPTIONS(self) -> None:
            self.answer(204, Access_Control_Allow_Methods="POST, OPTIONS", Access_Control_Allow_Headers="Authorization, Content-Type")

        def do_POST(self) -> None:
            if self.path not in ("/v1/logs", "/v1/query"):
                self.close_connection = True
                return self.answer(404, Connection="close")
            try:
                tenant = service.config.tokens.tenant(self.headers.get("Authorization"))
            except Unauthenticated:
                return self.fail("unauthenticated")
            return self.logs(tenant) if self.path == "/v1/logs" else self.sql(tenant)

        def logs(self, tenant: str) -> None:
            kind = (self.headers.get("Content-Type") or "").split(";")[0].strip().lower()
            if kind != PROTOBUF:
                return self.fail("invalid_request", "unsupported media type", 415)
            if (body := self.body(service.ingest_bytes)) is None:
                return self.fail("request_too_large", "too large", 413)
            try:
                service.accept(tenant, body)
            except (otlp.InvalidRequest, otlp.FutureTimestamp) as e:
                return self.fail("invalid_request", str(e))
            except frames.Busy:
                return self.fail("busy", "try again")
            except RuntimeError:
                return self.fail("storage", "frames cannot be written")
            return self.answer(200, b"", PROTOBUF)

        def sql(self, tenant: str) -> None:
            if (body := self.body(REQUEST_BYTES)) is None:
                return self.fail("request_too_large", f"more than {REQUEST_BYTES} bytes")
            try:
                return self.answer(200, service.query(tenant, body))
            except Failure as e:
                return self.fail(e.code, str(e), **e.more)

    return Handler


def serve(service: Service) -> ThreadingHTTPServer:
    """A listening server; its serve_forever() is still to be called."""
    return ThreadingHTTPServer((service.config.host, service.config.port), handler(service))


def main(path: str) -> None:
    """The daemon: publishes, sweeps and serves until interrupted."""
    from ..config import load

    spark = SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    service = Service(spark, load(Path(path).read_text()))
    consumer = threading.Thread(target=service.consume, daemon=True)
    consumer.start()
    service.janitor.start()
    server = serve(service)
    try:
        server.serve_forever()
    finally:
        server.server_close()
        service.stop()
        consumer.join(60)
