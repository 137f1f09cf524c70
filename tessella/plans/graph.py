"""Graphs of nodes as JSON: checked on the driver, then folded into one lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.pointwise import NodeError


@dataclass(frozen=True)
class Manifest:
    """What a node declares: port precisions, steps it needs and sets, colour roles and parameters."""

    takes: tuple[str, ...]
    gives: tuple[str, ...]
    needs: tuple[str, ...] = ()
    sets: tuple[str, ...] = ()
    role_in: str = "any"
    role_out: str = "any"
    params: dict[str, Any] = field(default_factory=dict)


# Bytes of a pixel by precision and the four conversions that may be put in by itself.
PIXEL_BYTES = {"r.u16": 2, "r.f32": 4, "rgba.f16": 8, "rgba.u8": 4, "rgba.u16": 8}
CONVERSIONS = {("r.u16", "r.f32"), ("r.f32", "rgba.f16"), ("rgba.f16", "rgba.u8"), ("rgba.f16", "rgba.u16")}

_RAW, _SCENE = "raw_camera", "scene_linear_rec2020"
_F16 = ("rgba.f16",)


def _scene(needs: str, sets: str, **params: Any) -> Manifest:
    return Manifest(_F16, _F16, (needs,) if needs else (), (sets,), _SCENE, _SCENE, params)


# What each node type declares.
NODES = {
    "builtin.passthrough": Manifest(("rgba.u8",), ("rgba.u8",)),
    "builtin.dng_input": Manifest((), ("r.u16",), role_in="none", role_out=_RAW, params={"path": str}),
    "linearize.dng_lut": Manifest(("r.u16",), ("r.f32",), (), ("linearization",), _RAW, _RAW),
    "blacklevel.dng_levels": Manifest(("r.f32",), ("r.f32",), ("linearization",), ("black_white_scaling",), _RAW, _RAW),
    "lens.shading_gainmap": Manifest(("r.f32",), ("r.f32",), (), ("lens_shading_gainmap",), _RAW, _RAW),
    "demosaic.quad_bayer_remosaic": Manifest(("r.u16",), ("r.u16",), (), ("quad_bayer_remosaic",), _RAW, _RAW),
    **{f"demosaic.{k}": Manifest(("r.f32",), _F16, ("black_white_scaling",), ("demosaic",), _RAW, _RAW) for k in ("bilinear", "rcd", "amaze")},
    "lens.dng_opcode_list_3": Manifest(_F16, _F16, (), ("opcode_list_3",), _RAW, _RAW),
    "wb.dual_illuminant": Manifest(_F16, _F16, ("demosaic",), ("white_balance",), _RAW, _RAW),
    "wb.greyworld_auto": Manifest(_F16, _F16, ("demosaic",), ("white_balance",), _RAW, _RAW),
    "colormatrix.dng_to_working": Manifest(_F16, _F16, ("white_balance",), ("color_matrix",), _RAW, _SCENE),
    "denoise.bm3d": _scene("color_matrix", "denoise.bm3d", sigma=(0, 0.2), sigma_override=(0, None)),
    "denoise.guided_filter": _scene("color_matrix", "denoise.guided_filter", radius=(1, 32), eps=(1e-5, 0.1)),
    "denoise.wavelet_bayes_shrink": _scene("color_matrix", "denoise.wavelet_bayes_shrink", chroma_strength=(0, 2)),
    "tone.reinhard": _scene("denoise.wavelet_bayes_shrink", "tone.reinhard", white_point=(0.1, 10)),
    "tone.aces_filmic": _scene("denoise.wavelet_bayes_shrink", "tone.aces_filmic", toggle=bool),
    "tone.filmic_rgb": _scene("denoise.wavelet_bayes_shrink", "tone.filmic_rgb", ev=(-2, 2), contrast=(0.5, 2), saturation=(0, 2), highlights=(0, 2), shadows=(0, 2)),
    "tone.mertens_local": _scene("denoise.wavelet_bayes_shrink", "tone_mertens_local", weight_contrast=(0, 2), weight_saturation=(0, 2), weight_well_exposedness=(0, 2)),
    "color.3d_lut": _scene("", "color.3d_lut", lut_path=str, interpolation=["tetrahedral", "trilinear"]),
    "sharpen.edge_aware_usm": _scene("color.3d_lut", "sharpen.edge_aware_usm", strength=(0, 2), radius=(1, 32), threshold=(0, 0.1)),
    "color.scene_linear_to_display": Manifest(_F16, ("rgba.u8", "rgba.u16"), (), ("color.scene_linear_to_display",), _SCENE, "any", {"target": ["sRGB", "BT2020-PQ", "DisplayP3", "BT2020-HLG"]}),
    "fusion.hdr_plus_derivative": Manifest(("r.u16",), ("r.u16",), (), ("burst_fusion_stub",), _RAW, _RAW),
    "precision_convert": Manifest(("r.u16", "r.f32", "rgba.f16"), ("r.f32", "rgba.f16", "rgba.u8", "rgba.u16"), (), ("precision_convert",)),
    "output.heif_sdr": Manifest(("rgba.u8",), (), ("color.scene_linear_to_display",), (), "output_srgb", "any", {"path": str}),
    "output.heif_hdr_pq": Manifest(("rgba.u16",), (), ("color.scene_linear_to_display",), (), "output_pq_rec2020", "any", {"path": str}),
}

#: Ports of the nodes that take several inputs, in the order of their functions.
PORTS = {"tone.mertens_local": ("under", "normal", "over"), "fusion.hdr_plus_derivative": ("ref", "frame")}


@dataclass
class Plan:
    order: list[str]
    nodes: dict[str, dict]
    edges: list[tuple[str, str]]
    steps: dict[str, list[str]]
    converts: list[tuple[str, str, str]]
    slots: dict[str, int]
    peak_bytes: int
    #: From, to and the port of every edge, those of the graph's own inputs too.
    inputs: list[tuple[str, str, str]] = field(default_factory=list)


def toposort(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Nodes after all they depend on; of those that are ready, the one that became so first."""
    waits = {n: sum(b == n for _, b in edges) for n in nodes}
    ready, out = [n for n in nodes if not waits[n]], []
    while ready:
        out.append(ready.pop(0))
        for a, b in edges:
            if a == out[-1]:
                waits[b] -= 1
                if not waits[b]:
                    ready.append(b)
    if len(out) < len(nodes):
        raise NodeError("BAD_INDEX", "the graph has a cycle")
    return out


def check_params(kind: str, params: dict[str, Any]) -> None:
    declared = NODES[kind].params
    for name, value in params.items():
        rule = declared.get(name)
        if rule is None:
            raise NodeError("BAD_INDEX", f"unknown parameter {name} of {kind}")
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        ok = value in rule if isinstance(rule, list) else isinstance(value, rule) if isinstance(rule, type) else number and (rule[0] is None or value >= rule[0]) and (rule[1] is None or value <= rule[1])
        if not ok:
            raise NodeError("BAD_INDEX", f"{kind}.{name}={value!r}")


def _slots(order: list[str], edges: list[tuple[str, str]], sizes: dict[str, int]) -> tuple[dict[str, int], int]:
    """First-fit slots for buffers that are never alive together, and the bytes of all slots."""
    place = {n: k for k, n in enumerate(order)}
    end = {n: max([place[b] for a, b in edges if a == n], default=place[n]) + 1 for n in order}
    slot: dict[str, int] = {}
    for n in order:
        taken = {slot[m] for m in slot if place[m] < end[n] and place[n] < end[m]}
        slot[n] = next(k for k in range(len(order)) if k not in taken)
    return slot, sum(max(sizes[n] for n in order if slot[n] == k) for k in set(slot.values()))


def plans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Order and live ranges of many graphs kept as tables: ``graph, id, place, stop, slot``.

    ``nodes(graph, id)`` and ``edges(graph, a, b)``, with ids of one type that sort in the order in which nodes were added. A
    node's result is alive from its ``place`` until before ``stop``; results of one slot are never alive together. A graph
    is a few rows, planned in one task with many others.
    """
    rows = nodes.select("graph", "id", F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("to")).union(edges.select("graph", "a", "b"))
    names, known = ["graph", "id", "place", "stop", "slot"], {}

    def planned(n: int, links: bytes) -> np.ndarray:
        """Place, stop and slot of the nodes 0 to ``n`` - 1 of a graph; those of small ones are kept, as many are alike."""
        if (n, links) in known:
            return known[n, links]
        own, pairs = list(range(n)), [tuple(p) for p in np.frombuffer(links, np.int64).reshape(-1, 2).tolist()]
        order = toposort(own, pairs)
        slots, _ = _slots(order, pairs, dict.fromkeys(own, 1))
        place = {v: k for k, v in enumerate(order)}
        stop = {v: place[v] + 1 for v in order}
        for a, b in pairs:
            stop[a] = max(stop[a], place[b] + 1)
        out = np.array([[place[v], stop[v], slots[v]] for v in own], np.int32).reshape(n, 3)
        if n <= 32 and len(known) < 20_000:
            known[n, links] = out
        return out

    def whole(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        """All graphs of a batch; each begins at one of ``begins``, its nodes by id before its edges."""
        is_edge = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        graph = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, batch.num_rows)))
        nodes, at, to = batch.filter(pa.array(~is_edge)), np.flatnonzero(~is_edge), np.flatnonzero(is_edge)
        owner, counts = graph[at], np.bincount(graph[at], minlength=len(begins))
        first = np.cumsum(counts) - counts
        # Ids as numbers in their order, so that a node is a number in the order of its graph and id.
        ids = pa.chunked_array([batch.column(1), batch.column(2).filter(pa.array(is_edge))]).to_numpy()
        values, code = np.unique(ids, return_inverse=True)
        key = owner * len(values) + code[at]
        ends = np.stack([graph[to] * len(values) + code[to], graph[to] * len(values) + code[batch.num_rows :]])
        found = np.searchsorted(key, ends)
        if len(to) and (not len(key) or (key[np.minimum(found, len(key) - 1)] != ends).any()):
            raise NodeError("BAD_INDEX", "an edge of a node that is not there")
        rank = np.ascontiguousarray((found - first[graph[to]]).T, dtype=np.int64)
        links = np.bincount(graph[to], minlength=len(begins))
        begin = np.cumsum(links) - links
        out = np.zeros((len(at), 3), np.int32)
        size = counts * (links.max(initial=0) + 1) + links
        for s in np.unique(size[counts > 0]):
            own = np.flatnonzero((size == s) & (counts > 0))
            n, m = counts[own[0]], links[own[0]]
            shapes = rank[begin[own][:, None] + np.arange(m)].reshape(len(own), 2 * m) if m else np.zeros((len(own), 1), np.int64)
            kinds, which = np.unique(shapes, axis=0, return_inverse=True)
            found = np.stack([planned(int(n), k.tobytes() if m else b"") for k in kinds])
            out[first[own][:, None] + np.arange(n)] = found[which.reshape(-1)]
        return pa.record_batch([nodes.column(0), nodes.column(1), *[pa.array(out[:, k]) for k in range(3)]], names=names)

    def run(batches):
        """Graphs of one sorted partition; a graph's rows may reach from one batch into the next."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, np.diff(code) != 0))
            if waiting and waiting[-1].column(0)[-1].as_py() == batch.column(0)[0].as_py():
                waiting.append(batch.slice(0, begins[1] if len(begins) > 1 else batch.num_rows))
                if len(begins) == 1:
                    continue
                begins = begins[1:]
            if waiting:
                yield whole(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], np.array([0]))
            if len(begins) > 1:
                own = batch.slice(begins[0], begins[-1] - begins[0])
                yield whole(own.take(pa.array(np.arange(own.num_rows))), begins[:-1] - begins[0])
            waiting = [batch.slice(begins[-1])]
        if waiting:
            yield whole(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], np.array([0]))

    kind = dict(nodes.dtypes)
    ordered = rows.repartition("graph").sortWithinPartitions("graph", F.col("to").isNotNull(), "id", "to")
    return ordered.mapInArrow(run, f"graph {kind['graph']}, id {kind['id']}, place int, stop int, slot int")


def interference(planned: DataFrame) -> DataFrame:
    """Pairs of results of a graph that are alive together: ``graph, one, other``.

    Places have no gaps, so what is alive with a result from its place on are those after it, until its stop: a graph, a
    few rows as in ``plans``, is put together once, and nothing is planned twice.
    """
    own = planned.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("place", "stop", "id"))).alias("p"))
    after = lambda x: F.slice("p", x["place"] + 2, x["stop"] - x["place"] - 1)
    pairs = F.flatten(F.transform("p", lambda x: F.transform(after(x), lambda y: F.struct(x["id"].alias("one"), y["id"].alias("other")))))
    return own.select("graph", F.explode(pairs).alias("pair")).select("graph", "pair.one", "pair.other")


def load(text: str, cap_bytes: int | None = None) -> Plan:
    """Checks a graph: version, nodes, parameters, edges, order, steps, colour roles, precisions and memory."""
    doc = json.loads(text)
    if doc.get("version") != "0.4" or not isinstance(doc.get("nodes"), list) or not isinstance(doc.get("edges"), list):
        raise NodeError("FAILED", "not a graph of version 0.4")
    nodes = {}
    for n in doc["nodes"]:
        kind = n["type"]
        if kind not in NODES or kind == "precision_convert":  # conversions are put in, never asked for
            raise NodeError("BAD_INDEX", f"node type {kind}")
        check_params(kind, n.get("params", {}))
        nodes[n["id"]] = {"type": kind, "params": n.get("params", {})}
    sources = set(doc.get("inputs", {})) if isinstance(doc.get("inputs"), dict) else {i["port"] for i in doc.get("inputs", [])}
    edges, inputs = [], []
    for e in doc["edges"]:
        a, b = e["from"].split(".")[0], e["to"].split(".")[0]
        if b not in nodes or a not in nodes and a not in sources | {"inputs"}:
            raise NodeError("BAD_INDEX", f"edge {e['from']} to {e['to']}")
        inputs.append((a, b, e["to"].partition(".")[2]))
        if a in nodes:
            edges.append((a, b))
    order = toposort(list(nodes), edges)
    steps: dict[str, list[str]] = {}
    role: dict[str, str] = {}
    converts = []
    target = {"sRGB": ("output_srgb", "rgba.u8"), "BT2020-PQ": ("output_pq_rec2020", "rgba.u16")}
    gives: dict[str, tuple[str, ...]] = {}
    for n in order:
        m, before = NODES[nodes[n]["type"]], [a for a, b in edges if b == n]
        seen = list(dict.fromkeys(s for a in before for s in steps[a]))
        if missing := [s for s in m.needs if s not in seen]:
            raise NodeError("NEED_METADATA", f"{n} needs {', '.join(missing)}")
        steps[n] = list(dict.fromkeys([*seen, *m.sets]))
        gives[n], role[n] = m.gives, m.role_out
        if nodes[n]["type"] == "color.scene_linear_to_display":
            role[n], own = target.get(nodes[n]["params"].get("target", "sRGB"), ("any", m.gives))
            gives[n] = (own,) if isinstance(own, str) else own
        for a in before:
            if "any" not in (role[a], m.role_in) and role[a] != m.role_in:
                raise NodeError("BAD_ROLE", f"{a} gives {role[a]}, {n} takes {m.role_in}")
            if gives[a] and m.takes and not set(gives[a]) & set(m.takes):
                step = next(((p, q) for p in gives[a] for q in m.takes if (p, q) in CONVERSIONS), None)
                if step is None:
                    raise NodeError("BAD_PRECISION", f"{a} gives {gives[a]}, {n} takes {m.takes}")
                converts.append((a, n, step[1]))
    size = next((i for i in (doc["inputs"].values() if isinstance(doc.get("inputs"), dict) else doc.get("inputs", []))), {})
    pixels = (size.get("width") or 0) * (size.get("height") or 0)
    slots, peak = _slots(order, edges, {n: pixels * PIXEL_BYTES[(gives[n] or ("rgba.u8",))[0]] for n in order})
    peak += pixels * PIXEL_BYTES["r.u16"]
    if cap_bytes is not None and peak > cap_bytes:
        raise NodeError("OUT_OF_MEMORY", f"{peak} bytes")
    return Plan(order, nodes, edges, steps, converts, slots, peak, inputs)


def migrate(text: str) -> str:
    """A graph of version 0.3 as one of 0.4; only the version and the schema's name change."""
    doc = json.loads(text)
    if doc.get("version") != "0.3":
        raise NodeError("FAILED", "not a graph of version 0.3")
    doc["version"] = "0.4"
    if isinstance(doc.get("$schema"), str):
        doc["$schema"] = doc["$schema"].replace("v0.3", "v0.4")
    return json.dumps(doc)


def kinds() -> list[str]:
    """All node types, sorted by name."""
    return sorted(NODES)


def fold(plan: Plan, source: Any, run: dict[str, Callable[..., Any]], convert: Callable[[Any, str], Any] | None = None) -> Any:
    """What the last node makes of ``source``.

    ``run`` has a function of (inputs..., params) for each node type, with inputs in the order of the type's ports;
    ``convert`` puts the plan's conversions in. Edges are honoured: a node that feeds several others feeds each the same.
    An input port that no edge reaches is an error, as is a node type without a function.
    """
    made: dict[str, Any] = {}
    for n in plan.order:
        kind = plan.nodes[n]["type"]
        if kind not in run:
            raise NodeError("NOT_IMPLEMENTED", kind)
        ports = PORTS.get(kind, ("in",))
        by_port = {port if len(ports) > 1 else ports[0]: a for a, b, port in plan.inputs if b == n}
        if len(ports) > 1 and set(by_port) != set(ports):
            raise NodeError("BAD_INDEX", f"{n} has inputs {sorted(by_port)}, not {sorted(ports)}")
        before = [(by_port[p], made[by_port[p]] if by_port[p] in made else source) for p in ports if p in by_port] or [("", source)]
        wanted = {a: target for a, b, target in plan.converts if b == n}
        ready = []
        for a, value in before:
            if a in wanted:
                if convert is None:
                    raise NodeError("NOT_IMPLEMENTED", f"conversion to {wanted[a]}")
                value = convert(value, wanted[a])
            ready.append(value)
        made[n] = run[kind](*ready, plan.nodes[n]["params"])
    return made[plan.order[-1]]
