"""The engine's control plane over HTTP, on the driver: channels, thresholds, display types, configuration.

Changes count from the next run or micro-batch on. Answers have the form of the engine's own, {Code, Msg, Result}.
"""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from strandline.plans.engine import MISSING_FIELD, NO_GRAPH, OK, PipelineEngine

DETECTORS = ("yolov5", "yolov7", "yolov8", "yolox", "retinaface")
#: Which elements a display type or the depth configuration belongs to.
DISPLAY = {"/display-type-blend": "blend", "/display-type-dpu": "ive"}
CONFIGURED = "dpu"


class Control:
    """Routes to the engine; `handle` is free of HTTP."""

    def __init__(self, engine: PipelineEngine):
        self.engine = engine

    def _elements(self, *names: str, number: int | None = None):
        return [(g, i) for g, graph in self.engine.graphs.items() for i, e in graph.elements.items() if e.name.removesuffix("_group") in names and number in (None, i)]

    def _set(self, elements, **values) -> dict:
        for g, i in elements:
            self.engine.configure(g, i, **values)
        return self.engine._answer(OK, "success") if elements else self.engine._answer(NO_GRAPH, "no such element")

    def handle(self, method: str, path: str, body: dict) -> dict | None:
        """The answer to a request, None for an unknown route."""
        if (method, path) == ("POST", "/stream/addChannel"):
            return self.engine.add_channel(body)
        if (method, path) == ("POST", "/stream/stopChannel"):
            return self.engine.stop_channel(body)
        if method == "POST" and (m := re.fullmatch(r"/(\w+)/SetConfThreshold/(\d+)", path)) and m[1] in DETECTORS:
            value = body.get("value")
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
                return self.engine._answer(MISSING_FIELD, "value must be a number from 0 to 1")
            return self._set(self._elements(m[1], number=int(m[2])), threshold_conf=float(value))
        if method == "PUT" and path in DISPLAY:
            if "display_type" not in body:
                return self.engine._answer(MISSING_FIELD, "display_type missing")
            return self._set(self._elements(DISPLAY[path]), display_type=body["display_type"])
        if path == "/config" and method == "PUT":
            return self._set(self._elements(CONFIGURED), **body)
        if path == "/config" and method == "GET":
            return self.engine._answer(OK, "success", [{k: str(v) for k, v in self.engine.graphs[g].elements[i].configure.items()} for g, i in self._elements(CONFIGURED)])
        return None


def serve(engine: PipelineEngine, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Starts the service in a thread of its own; `shutdown()` of the result ends it. Port 0 takes a free one."""
    control, lock = Control(engine), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _serve(self):
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("the body is no object")
                with lock:
                    answer, status = control.handle(self.command, self.path, body), 200
                if answer is None:
                    answer, status = engine._answer(NO_GRAPH, f"no route {self.path}"), 404
            except (ValueError, TypeError) as e:
                answer, status = engine._answer(MISSING_FIELD, str(e)), 400
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = _serve

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
