"""The engine: named graphs, channels and their control, and the task service before it."""

from __future__ import annotations

import copy
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import graph as G

#: Fixed values of the control protocol.
OK, MISSING_FIELD, NO_GRAPH, TIMEOUT = 0, 5008, 1, 2
CHANNEL_DEFAULTS = {"sample_interval": 1, "decode_id": -1, "fps": 1, "loop_num": 1, "sample_strategy": "DROP", "graph_id": 0}
ALGORITHMS = {1: "tripwire", 2: "license_area_intrusion", 3: "yolov5", 4: "yolov8", 5: "openpose"}
MAX_CHANNELS = 100


class ChannelTable:
    """Dense numbers of a graph's channels; a freed number is given to the next channel, first freed first."""

    def __init__(self):
        self.by_id: dict[int, int] = {}
        self.free: list[int] = []

    def start(self, channel: int) -> int:
        if channel not in self.by_id:
            self.by_id[channel] = self.free.pop(0) if self.free else len(self.by_id)
        return self.by_id[channel]

    def stop(self, channel: int) -> bool:
        if channel not in self.by_id:
            return False
        self.free.append(self.by_id.pop(channel))
        return True


class PipelineEngine:
    """Holds graphs, compiles them over relations and runs their sinks in batch or as streaming queries."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graphs: dict[int, G.Graph] = {}
        self.handlers: dict[tuple[int, int, int], Callable] = {}
        self.channels: dict[int, ChannelTable] = {}
        self.requests: dict[tuple[int, int], dict] = {}
        self.state: dict[int, str] = {}
        self.queries: dict[int, list] = {}
        self.settings: dict[tuple[int, str], object] = {}

    def add_graph(self, spec: dict, base: str = ".", load=None) -> int:
        g = G.parse_graph(spec, base, load)
        if g.graph_id in self.graphs:
            raise G.ConfigError(f"graph {g.graph_id} is there already")
        G.validate(g)
        self.graphs[g.graph_id], self.channels[g.graph_id], self.state[g.graph_id] = g, ChannelTable(), "ready"
        return g.graph_id

    def remove_graph(self, graph_id: int) -> None:
        self.stop(graph_id)
        for d in (self.graphs, self.channels, self.state):
            d.pop(graph_id, None)

    def graph_exists(self, graph_id: int) -> bool:
        return graph_id in self.graphs

    def graph_ids(self) -> list[int]:
        return sorted(self.graphs)

    def set_sink_handler(self, graph_id: int, element: int, port: int, handler: Callable[[G.FrameSet], None]) -> None:
        if port not in self.graphs[graph_id].elements[element].sinks:
            raise G.ConfigError(f"port {port} of element {element} is no sink")
        self.handlers[(graph_id, element, port)] = handler

    def add_channel(self, request: dict) -> dict:
        """Starts a channel from a request body; returns the protocol's answer."""
        missing = [k for k in ("url", "source_type", "channel_id") if request.get(k) is None]
        if missing:
            return self._answer(MISSING_FIELD, f"{', '.join(missing)} missing")
        r = CHANNEL_DEFAULTS | {k: v for k, v in request.items() if v is not None}
        if r["graph_id"] not in self.graphs:
            return self._answer(NO_GRAPH, f"no graph {r['graph_id']}")
        number = self.channels[r["graph_id"]].start(int(r["channel_id"]))
        self.requests[(r["graph_id"], int(r["channel_id"]))] = r
        return self._answer(OK, "success", [{"Status": 1, "TaskID": number}])

    def stop_channel(self, request: dict) -> dict:
        g, c = int(request.get("graph_id", 0)), request.get("channel_id")
        if c is None:
            return self._answer(MISSING_FIELD, "channel_id missing")
        done = g in self.channels and self.channels[g].stop(int(c))
        self.requests.pop((g, int(c)), None)
        return self._answer(OK if done else NO_GRAPH, "success" if done else f"no channel {c}")

    @staticmethod
    def _answer(code: int, message: str, result: list | None = None) -> dict:
        return {"Code": code, "Msg": message, "Result": result or []}

    def configure(self, graph_id: int, element: int, **values) -> None:
        """Changes an element's settings; later runs and micro-batches compile with them (thresholds, display types, ...)."""
        self.graphs[graph_id].elements[element].configure.update(values)

    def _sampled(self, graph_id: int, frames: DataFrame) -> DataFrame:
        """Only started channels, each with its own sampling."""
        mine = {c: r for (g, c), r in self.requests.items() if g == graph_id}
        if not mine:
            return frames
        step = F.create_map(*[F.lit(v) for c, r in mine.items() for v in (c, int(r["sample_interval"]))])
        rows = frames.where(F.col("channel_id").isin(list(mine)))
        return rows.where((F.col("frame_id") % F.try_element_at(step, F.col("channel_id")) == 0) | F.coalesce(F.col("eos"), F.lit(False)))

    def run(self, graph_id: int, source: G.FrameSet) -> dict[tuple[int, int], G.FrameSet]:
        """Compiles the graph over the relations and calls its sink handlers; returns the sinks' relations."""
        if self.state.get(graph_id) == "paused":
            return {}
        source = dict(source) | {"frames": self._sampled(graph_id, source["frames"])}
        out = G.compile_graph(copy.deepcopy(self.graphs[graph_id]), source)
        for (element, port), fs in out.items():
            if h := self.handlers.get((graph_id, element, port)):
                h(fs)
        return out

    def start(self, graph_id: int, frames: DataFrame, relations: G.FrameSet, checkpoint: str, once: bool = True):
        """Runs the graph over every micro-batch of a stream of frames."""
        def batch(df: DataFrame, _: int) -> None:
            self.run(graph_id, dict(relations) | {"frames": df})

        w = frames.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(checkpoint, f"graph-{graph_id}"))
        q = (w.trigger(availableNow=True) if once else w).start()
        self.queries.setdefault(graph_id, []).append(q)
        self.state[graph_id] = "running"
        return q

    def stop(self, graph_id: int) -> None:
        for q in self.queries.pop(graph_id, []):
            q.stop()
        if graph_id in self.state:
            self.state[graph_id] = "stopped"

    def pause(self, graph_id: int) -> None:
        self.state[graph_id] = "paused"

    def resume(self, graph_id: int) -> None:
        self.state[graph_id] = "running"


def check_files(config: dict | list, base: str = ".") -> list[str]:
    """Files that a configuration names under model_path, shared_object or class_names and that aren't there."""
    missing = []
    if isinstance(config, list):
        return [m for c in config for m in check_files(c, base)]
    for k, v in config.items():
        if k in ("model_path", "shared_object", "class_names", "class_names_file") and isinstance(v, str) and not os.path.exists(os.path.join(base, v)):
            missing.append(v)
        elif isinstance(v, (dict, list)) and not (isinstance(v, list) and v and not isinstance(v[0], dict)):
            missing += check_files(v, base)
    return missing


class TaskService:
    """Tasks over the engine: create, delete, query, list, and the alarms of a task's channel."""

    def __init__(self):
        self.tasks: dict[str, dict] = {}

    def create(self, request: dict) -> dict:
        task = str(request["TaskID"])
        entry = request["Algorithm"][0]  # one algorithm a task
        if entry["Type"] not in ALGORITHMS:
            return {"Code": -1, "Msg": f"no algorithm {entry['Type']}"}
        if task in self.tasks and self.tasks[task]["status"] == 1:
            return {"Code": -1, "Msg": "task is running"}
        used = {t["channel"] for t in self.tasks.values()}
        free = next((c for c in range(MAX_CHANNELS) if c not in used), None)
        if free is None:
            return {"Code": -1, "Msg": "no channel is free"}
        self.tasks[task] = {"channel": free, "source": request.get("InputSrc", {}).get("SrcID"), "algorithm": ALGORITHMS[entry["Type"]], "type": entry["Type"], "report": request.get("Reporting", {}).get("ReportUrlList", []), "config": entry, "status": 1}
        return {"Code": 0, "Msg": "success"}

    def delete(self, task: str) -> dict:
        return {"Code": 0, "Msg": "success"} if self.tasks.pop(str(task), None) else {"Code": -1, "Msg": "failed"}

    def query(self, task: str) -> dict:
        t = self.tasks.get(str(task))
        return {"Code": 0, "Msg": "success", "Result": {"TaskID": str(task), "Status": t["status"]}} if t else {"Code": 1, "Msg": "fail"}

    def list(self) -> dict:
        return {"Code": 0, "Msg": "success", "Result": [{"TaskID": k, "Status": t["status"]} for k, t in self.tasks.items()]}

    def table(self, spark: SparkSession) -> DataFrame:
        """channel_id, task_id, source, type: for joining alarms to their tasks."""
        return spark.createDataFrame([(t["channel"], k, t["source"], t["type"]) for k, t in self.tasks.items()], "channel_id int, task_id string, source string, type int")

    def alarms(self, payloads: DataFrame) -> DataFrame:
        """Frame JSON with the task of its channel, re-shaped for alarm receivers."""
        from strandline.sources.sinks import alarm_json

        channel = F.get_json_object("payload", "$.mFrame.mChannelId").cast("int")
        rows = payloads.withColumn("channel_id", channel).join(F.broadcast(self.table(payloads.sparkSession)), "channel_id")
        return alarm_json(rows, F.col("task_id"), F.col("source"), F.col("type"))
