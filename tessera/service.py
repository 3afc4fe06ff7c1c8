"""A small HTTP service over one session: queries are queued, run in order, and their results kept."""

from __future__ import annotations

import hashlib
import json
import queue
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tessera import engine, model
from tessera.functions import render
from tessera.model import EngineConf, RegionQuery
from tessera.sources import tables


class RegionService:
    """Routes: BRS (a query), alive, flushBuffer, changeProteus (source), changeAlgo, removeTables."""

    def __init__(self, spark: SparkSession, conf: EngineConf, load=None):
        self.spark, self.conf, self.load = spark, conf, load or self._extract
        self.results: dict[str, dict] = {}
        self.lock, self.jobs, self.busy = threading.RLock(), queue.Queue(), threading.Event()
        self._restore()
        threading.Thread(target=self._work, daemon=True).start()

    def _restore(self) -> None:
        path = Path(self.conf.results)
        for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else []:
            row = json.loads(line)
            self.results[row["key"]] = row

    def _persist(self) -> None:
        with self.lock:
            rows = [r for r in self.results.values() if r["out"] or r["error"]]
            render.replace_file(self.conf.results, "".join(json.dumps(r) + "\n" for r in rows))

    def source(self) -> str:
        """What tells sources apart, without the password or other parts of the address."""
        return hashlib.sha256(f"{self.conf.jdbc_url} {self.conf.user}".encode()).hexdigest()[:16]

    def extracts(self) -> str:
        """The folder of the source's extracts."""
        return f"{self.conf.extracts}/{self.source()}"

    def _extract(self, query: RegionQuery) -> DataFrame:
        columns = [query.keywords_column, query.keywords_column2, query.f]
        fetch = lambda: tables.read_jdbc(self.spark, self.conf.jdbc_url, query.input, columns, self.conf.user, self.conf.password)
        return tables.cached_extract(self.spark, self.extracts(), query.input, columns, fetch)

    def _work(self) -> None:
        while True:
            key, query = self.jobs.get()
            self.busy.set()
            out, error = "", ""
            try:
                found = engine.top_regions(self.load(query), query)
                out = render.result_json(found, whole_scores=model.strategy_name(query.algo) == "uniform")
            except AnalysisException as e:
                kind = e.getCondition() or ""
                error = "Table not found" if "PATH_NOT_FOUND" in kind or "TABLE" in kind else "Column not found" if "COLUMN" in kind else str(e)[:300]
            except Exception as e:  # the service answers with it
                error = f"{type(e).__name__}: {e}"[:300]
            with self.lock:
                if key in self.results:
                    self.results[key] |= {"out": out, "error": error}
            try:
                self._persist()
            except OSError as e:  # answers stay in memory; the next query tries again
                print(f"results were not saved: {e}", file=sys.stderr)
            self.busy.clear()
            self.jobs.task_done()

    def ask(self, given: dict) -> str:
        try:
            query = RegionQuery.from_parameters({"algo": self.conf.algo, "partitions": self.conf.partitions, **given})
        except model.InvalidQuery as e:
            return f"Error: {e}"
        key = json.dumps([self.source(), *query.key()])
        with self.lock:
            row = self.results.get(key)
            if row is None:
                self.results[key] = {"key": key, "out": "", "error": ""}
                self.jobs.put((key, query))
                return "Your query has been submitted; ask again for its result"
        return row["error"] or row["out"] or "Your query is being processed"

    def alive(self) -> str:
        if self.spark.sparkContext._jsc.sc().isStopped():
            return "error"
        return "not free" if self.busy.is_set() or self.spark.sparkContext.statusTracker().getActiveStageIds() else "free"

    def flush(self) -> str:
        with self.lock:
            self.results.clear()
        self._persist()
        return "Done"

    def change_source(self, url: str = "", username: str = "", password: str = "", **_: str) -> str:
        """From now on queries go to this source; answers and extracts of others are kept apart."""
        if not (url.strip() and username.strip() and password.strip()):
            return "Error: url, username and password are needed"
        self.conf.jdbc_url, self.conf.user, self.conf.password = url, username, password
        return "Done"

    def change_algo(self, algo: str = "", **_: str) -> str:
        try:
            self.conf.algo = int(algo) if algo.isdigit() else model.strategy_name(algo)
            model.strategy_name(self.conf.algo)
        except model.InvalidQuery as e:
            return f"Error: {e}"
        return "Done"

    def remove_tables(self, table: str = "", **_: str) -> str:
        """Forget the source's extracts of a table, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.extracts()}/*")
        store, own = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), tables.extract_name(table, [])
        for status in store.globStatus(path) or []:
            name = status.getPath().getName()
            if not table or name == own or name.startswith(own + "-"):  # columns follow a hyphen, which no table name has
                store.delete(status.getPath(), True)
        return "Done"

    def answer(self, path: str, given: dict) -> str | None:
        given = {{"pass": "password"}.get(k, k): v for k, v in given.items()}
        routes = {"/alive": lambda: self.alive(), "/BRS": lambda: self.ask(given), "/flushBuffer": lambda: self.flush(), "/changeProteus": lambda: self.change_source(**given), "/changeAlgo": lambda: self.change_algo(**given), "/removeTables": lambda: self.remove_tables(**given)}
        return routes[path]() if path in routes else None

    def serve(self) -> ThreadingHTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlparse(self.path)
                body = service.answer(url.path, dict(parse_qsl(url.query)))
                self.send_response(404 if body is None else 200)
                self.end_headers()
                self.wfile.write((body or "unknown route").encode())

            def log_message(self, *_):
                pass

        server = ThreadingHTTPServer((self.conf.host, self.conf.port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
