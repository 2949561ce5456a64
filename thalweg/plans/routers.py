"""Routers: a configuration in, discharge and states out."""

from __future__ import annotations

import logging
import sys
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.kernels import by_step, convolve, convolve_blocks, packed
from thalweg.operators import routing, runoff, validate
from thalweg.operators.network import with_roots
from thalweg.plans.config import Config
from thalweg.session import written
from thalweg.sources import cache, io

PROGRESS = 25
logging.addLevelName(PROGRESS, "PROGRESS")


class Muskingum:
    """Channel routing of an initial state, without lateral inflow. Subclasses may override the hooks."""

    kind: routing.Kind = "channel"
    volumes = False

    def __init__(self, spark: SparkSession, config: str | None = None, **options: Any):
        self.spark = spark
        self.cfg = config if isinstance(config, Config) else Config.load(config, **options)
        self.sink: io.Sink = lambda df, path, source: io.write_discharge(df, path, source, self.cfg.var_discharge)
        self.log = logging.getLogger(f"thalweg.{type(self).__name__}")
        self.log.setLevel(self.cfg.log_level)
        self.log.disabled = not self.cfg.log
        if self.cfg.log and not self.log.handlers:
            handler = logging.StreamHandler(sys.stdout) if self.cfg.log_stream == "stdout" else logging.FileHandler(self.cfg.log_stream)
            handler.setFormatter(logging.Formatter(self.cfg.log_format))
            self.log.addHandler(handler)
        self.check_options()

    def check_options(self) -> None:
        for name in ("dt_routing", "dt_total"):
            if not getattr(self.cfg, name):
                raise ValueError(f"missing option: {name}")
        if not self.cfg.channel_state_init_file:
            raise ValueError("missing option: channel_state_init_file")
        if len(self.cfg.discharge_files) != 1:
            raise ValueError("channel routing has exactly one output")

    def set_write_discharges(self, sink: io.Sink) -> Muskingum:
        """Another sink: called with (river_id, time, q), the output path and the input's path."""
        self.sink = sink
        return self

    def before_route(self) -> None:
        """A hook."""

    def after_route(self) -> None:
        """A hook."""

    def network(self) -> DataFrame:
        """The checked network with the roots of its rivers and whether they are fed, found once for all inputs, and once for all runs where a folder keeps it."""
        cfg = self.cfg
        by_order = cfg.params_in_order or any(io.without_ids(self.spark, p) for p in (cfg.channel_state_init_file, cfg.uh_kernel_file, cfg.uh_state_init_file))

        def checked() -> DataFrame:
            net = written(io.read_params(self.spark, cfg.params_file, cfg.var_river_id, by_order), "parameters")
            validate.require(validate.params(net if cfg.params_in_order else net.drop("position")), "routing parameters")
            return routing.with_fed(with_roots(net))

        if not cfg.network_cache_dir:
            return written(checked(), "network")
        return cache.kept(self.spark, cfg.network_cache_dir, "network", cache.digest([cfg.params_file], cfg.var_river_id, by_order, cfg.params_in_order), checked)

    def progress(self, done: int, of: int, what: str) -> None:
        if self.cfg.progress_bar:
            self.log.log(PROGRESS, "%s of %s inputs routed: %s", done, of, what)

    def route(self, state: DataFrame | None = None) -> Muskingum:
        """Routes all inputs; starts from `state`, or the configured one, in each call."""
        self.net = self.network()
        self.state = state if state is not None else io.read_state(self.spark, self.cfg.channel_state_init_file, self.net, self.cfg.var_discharge)
        self.before_route()
        self.execute()
        self.after_route()
        io.write_state(self.state, self.cfg.channel_state_final_file, self.cfg.var_discharge)
        self.log.log(PROGRESS, "routed")
        return self

    def execute(self) -> None:
        cfg = self.cfg
        out_step = cfg.dt_discharge or cfg.dt_routing
        steps = routing.Steps(cfg.dt_routing, out_step, out_step, cfg.dt_total)
        routed = written(routing.route(self.kind, self.net, None, steps.total // out_step, out_step, steps.substeps, self.state, strategy=cfg.strategy), "routed")
        self.state = routed.select("river_id", F.col("state").alias("q"))
        self.sink(io.with_dates(routing.long_series(routed), cfg.start_datetime, out_step).select("river_id", "time", "q"), cfg.discharge_files[0], "")


class RapidMuskingum(Muskingum):
    """Lateral inflow volumes go straight into the channel."""

    kind = "rapid"
    volumes = True

    def check_options(self) -> None:
        cfg = self.cfg
        if bool(cfg.qlateral_files) == bool(cfg.grid_runoff_files) or bool(cfg.grid_runoff_files) != bool(cfg.grid_weights_file):
            raise ValueError("give either qlateral_files, or grid_runoff_files with grid_weights_file")
        if len(cfg.discharge_files) != len(cfg.qlateral_files or cfg.grid_runoff_files):
            raise ValueError("there must be as many outputs as inputs")

    def inputs(self) -> list[str]:
        return self.cfg.qlateral_files or self.cfg.grid_runoff_files

    def lateral(self, path: str) -> tuple[DataFrame, int, int, str]:
        """river_id, t, v of an input; its step in seconds, number of steps, and first time."""
        cfg = self.cfg
        if cfg.qlateral_files:
            df = io.read_series(self.spark, [path], cfg.var_qlateral, cfg.var_t, cfg.var_river_id).select("river_id", "time", F.coalesce("v", F.lit(0.0)).alias("v"))
        else:
            grid = io.read_grid(self.spark, [path], cfg.var_grid_runoff, cfg.var_x, cfg.var_y, cfg.var_t)
            weights = io.read_weights(self.spark, cfg.grid_weights_file, cfg.var_river_id)
            seconds = grid.withColumn("time", F.unix_seconds(F.to_timestamp_ltz(F.col("time").cast("string"))))
            df = runoff.to_qlateral(
                seconds, weights, unit=cfg.runoff_depth_unit, cumulative=cfg.grid_accumulation_type == "cumulative", force_positive=cfg.force_positive_runoff, uniform=cfg.force_uniform_timesteps, volumes=self.volumes, time="time"
            ).withColumn("time", F.timestamp_seconds("time").cast("timestamp_ntz"))
        df = written(df, "lateral")
        times = written(df.select("time").distinct(), "times")
        first, last, n = times.agg(F.min("time"), F.max("time"), F.count(F.lit(1))).first()
        step = self.cfg.dt_runoff or first_step(times, first) or self.cfg.dt_total
        if not step:
            raise ValueError("dt_runoff is needed for an input of one step")
        since = F.timestamp_diff("SECOND", F.lit(first), F.col("time"))
        if (last - first).total_seconds() != step * (n - 1) or not times.where(since % step != 0).isEmpty():
            raise ValueError(f"the times of {path} are not {step} s apart throughout; repair them, with force_uniform_timesteps for gridded runoff")
        return df.select("river_id", (since / step).cast("int").alias("t"), F.nanvl("v", F.lit(0.0)).alias("v")), step, n, first.isoformat(" ")

    def transform(self, lateral: DataFrame) -> DataFrame:
        """What reaches the channel; a hook for other transformations. lateral: river_id, t, v, and in ensembles member."""
        return lateral

    def steps(self, dt_runoff: int, n: int) -> routing.Steps:
        cfg = self.cfg
        out = routing.Steps(cfg.dt_routing or dt_runoff, dt_runoff, cfg.dt_discharge or dt_runoff, cfg.dt_total or dt_runoff * n)
        if out.total != dt_runoff * n:
            raise ValueError(f"dt_total is {out.total} s but the input has {n} steps of {dt_runoff} s")
        return out

    def passed_on(self, routed: DataFrame, steps: routing.Steps, first: str, out: str, path: str) -> None:
        """Discharge to the sink, at the output's step."""
        series = routing.long_series(routed)
        if steps.discharge > steps.runoff:
            series = routing.mean_by(series, steps.discharge // steps.runoff, "river_id")
        self.sink(io.with_dates(series, first, steps.discharge).select("river_id", "time", "q"), out, path)

    def execute(self) -> None:
        if self.cfg.runoff_processing_mode == "ensemble":
            self.execute_ensemble()
            return
        inputs = self.inputs()
        for k, (path, out) in enumerate(zip(inputs, self.cfg.discharge_files, strict=True), 1):
            lateral, dt_runoff, n, first = self.lateral(path)
            steps = self.steps(dt_runoff, n)
            routed = routing.route(self.kind, self.net, self.transform(lateral), n, dt_runoff, steps.substeps, self.state, strategy=self.cfg.strategy, kept=True)
            self.state = routed.select("river_id", F.col("state").alias("q"))
            self.passed_on(routed, steps, first, out, path)
            self.progress(k, len(inputs), path)

    def members(self) -> tuple[DataFrame, list[tuple[int, int, str]]]:
        """member (the input's number), river_id, t, v of all inputs, and of each its step, number of steps and first time. Files are read at once."""
        cfg, inputs = self.cfg, self.inputs()
        if cfg.grid_runoff_files:  # each is aggregated by itself
            each = [self.lateral(path) for path in inputs]
            return reduce(DataFrame.unionByName, [x[0].withColumn("member", F.lit(str(k))) for k, x in enumerate(each)]), [x[1:] for x in each]
        df = io.read_series(self.spark, sorted(set(inputs)), cfg.var_qlateral, cfg.var_t, cfg.var_river_id)
        times = written(df.select("source", "time").distinct(), "times")
        ends = times.groupBy(F.col("source").alias("path")).agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count(F.lit(1)).alias("n"))
        second = times.join(F.broadcast(ends), F.col("source") == F.col("path")).where(F.col("time") > F.col("first")).groupBy("path").agg(F.min("time").alias("second"))
        found = {r["path"]: r for r in ends.join(second, "path", "left").collect()}  # a row an input
        about = []
        for k, path in enumerate(inputs):
            r = found.get(path)
            step = cfg.dt_runoff or (int((r["second"] - r["first"]).total_seconds()) if r and r["second"] else 0) or cfg.dt_total
            if not r or not step:
                raise ValueError(f"dt_runoff is needed for an input of one step: {path}")
            about.append((path, str(k), r["first"], step, r["n"], (r["last"] - r["first"]).total_seconds() == step * (r["n"] - 1)))
        known = F.broadcast(self.spark.createDataFrame([x[:4] for x in about], "path string, member string, first timestamp_ntz, step int"))
        since = F.timestamp_diff("SECOND", F.col("first"), F.col("time"))
        uneven = times.join(known, F.col("source") == F.col("path")).where(since % F.col("step") != 0)
        if not all(x[5] for x in about) or not uneven.isEmpty():
            raise ValueError("the times of an input are not one step apart throughout; repair them, with force_uniform_timesteps for gridded runoff")
        rows = df.join(known, F.col("source") == F.col("path")).select("member", "river_id", (since / F.col("step")).cast("int").alias("t"), F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).alias("v"))
        return rows, [(step, n, first.isoformat(" ")) for _, _, first, step, n, _ in about]

    def execute_ensemble(self) -> None:
        """Every member from the same state; members with the same steps are routed together, and each output reads its own member's rows."""
        rows, about = self.members()
        finals = []
        for dt_runoff, n in dict.fromkeys(x[:2] for x in about):
            steps, own = self.steps(dt_runoff, n), [k for k, x in enumerate(about) if x[:2] == (dt_runoff, n)]
            lateral = self.transform(rows.where(F.col("member").isin([str(k) for k in own])))
            routed = routing.route(self.kind, self.net, lateral, n, dt_runoff, steps.substeps, self.state, member="member", strategy=self.cfg.strategy, kept=True)
            finals.append(routed.select("river_id", F.col("state").alias("q")))
            for k in own:
                self.passed_on(routed.where(F.col("member") == str(k)), steps, about[k][2], self.cfg.discharge_files[k], self.inputs()[k])
                self.progress(k + 1, len(about), self.inputs()[k])
        self.state = mean_state(finals)


class UnitMuskingum(RapidMuskingum):
    """Lateral inflow depths are convolved with unit hydrographs; headwaters carry the result, the others route it."""

    kind = "unit"
    volumes = False

    def check_options(self) -> None:
        super().check_options()
        if not self.cfg.uh_kernel_file:
            raise ValueError("missing option: uh_kernel_file")

    def before_route(self) -> None:
        self.kernels = written(io.read_kernel(self.spark, self.cfg.uh_kernel_file, self.net), "kernels")
        self.kernel_step = io.kernel_step(self.spark, self.cfg.uh_kernel_file)
        self.first_carry = io.read_kernel_state(self.spark, self.cfg.uh_state_init_file, self.kernels, self.net) if self.cfg.uh_state_init_file else None
        self.carry = self.first_carry

    def steps(self, dt_runoff: int, n: int) -> routing.Steps:
        """Kernels of another step would change volumes by the steps' ratio."""
        if self.kernel_step and self.kernel_step != dt_runoff:
            raise ValueError(f"kernels of steps of {self.kernel_step} s do not fit inflow of steps of {dt_runoff} s")
        return super().steps(dt_runoff, n)

    def transform(self, lateral: DataFrame) -> DataFrame:
        """In ensembles every member starts from the same carry-over. Where routing goes by chunks of time, so does the convolution."""
        keys = ("river_id", *(["member"] if "member" in lateral.columns else []))
        carry = self.carry if self.cfg.runoff_processing_mode == "sequential" else self.first_carry
        in_blocks = self.cfg.strategy == "chunks"
        found = convolve_blocks(lateral, self.kernels, carry, keys) if in_blocks else convolve(packed(lateral, "t", "v", "v", *keys), self.kernels, carry, keys)
        out = written(found, "convolved")
        own = out.where(F.col("member") == str(len(self.inputs()) - 1)) if "member" in keys else out
        self.carry = own.where("state IS NOT NULL").select("river_id", "state")
        return by_step(out, *keys) if in_blocks else out.select(*keys, F.posexplode("v").alias("t", "v"))

    def after_route(self) -> None:
        if self.cfg.uh_state_final_file:
            io.write_kernel_state(self.carry, self.cfg.uh_state_final_file)


def first_step(times: DataFrame, first) -> int | None:
    """Seconds from the first time to the second; none of a single one."""
    second = times.where(F.col("time") > F.lit(first)).agg(F.min("time")).first()[0]
    return None if second is None else int((second - first).total_seconds())


def mean_state(states: list[DataFrame]) -> DataFrame:
    """The unweighted mean of members' states."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("river_id").agg(F.avg("q").alias("q"))


ROUTERS = {"Muskingum": Muskingum, "RapidMuskingum": RapidMuskingum, "UnitMuskingum": UnitMuskingum}
