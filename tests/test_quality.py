"""Quality rules on injections made by hand."""

import json

from tracejobs.operators import quality


def test_rules(spark):
    spans = [("d", 1, "a", "", "web", "normal", 1), ("d", 1, "b", "a", "api", "normal", 1), ("d", 1, "c", "b", "api", "abnormal", 1), ("e", 2, "a", "", "web", "normal", 7 * 10**9), ("e", 3, "a", "", "web", "abnormal", 1), ("f", 4, "x", "", "web", "normal", 1), ("f", 4, "x", "", "web", "normal", 1)]
    df = spark.createDataFrame(spans, "datapack string, trace_id long, span_id string, parent_span_id string, service_name string, period string, duration long")
    net = lambda way, **k: ("NetworkDelay", {"direction": way, "injection_point": {"source_service": "web", "target_service": "api", **k}})
    cases = [
        (net("from"), set()), (net("to"), {"network_no_direct_calls"}), (net("both"), set()), (net("from", direction="to"), {"network_no_direct_calls"}), (net("to", target_service=""), set()),
        (("HTTPRequestReplaceMethod", {"replace_method": 1, "injection_point": {"method": "POST"}}), {"http_method_same"}), (("HTTPRequestReplaceMethod", {"replace_method": "GET", "injection_point": {"method": "POST"}}), set()),
        (("HTTPAbort", {"injection_point": {"app_name": "web", "server_address": "api"}}), set()), (("HTTPAbort", {"injection_point": {"app_name": "api", "server_address": "web"}}), {"http_no_direct_calls"}), (("HTTPAbort", {"injection_point": {"app_name": "api", "server_address": "api"}}), set()),
        (("PodFailure", {"injection_point": {"app_label": "gone", "app_name": "web"}}), {"target_not_called"}), (("PodFailure", {"app_label": "gone"}), set()), (("PodFailure", {"injection_point": {}}), set()), (("PodFailure", None), set()),
    ]
    rows = [("d", i, fault, None if config is None else json.dumps(config)) for i, ((fault, config), _) in enumerate(cases)] + [("e", 90, "PodFailure", '{"injection_point": {"app_label": "web"}}'), ("f", 91, "PodFailure", '{"injection_point": {"app_label": "web"}}'), ("g", 92, "PodFailure", '{"injection_point": {"app_label": "web"}}')]
    injections = spark.createDataFrame(rows, "datapack string, i int, fault_type string, display_config string")
    for i, (_, wanted) in enumerate(cases):
        (r,) = quality.quality_rules(injections.where(f"i = {i}"), df).collect()
        assert ({n for n in quality.RULES if r[n]}, r.kicked_out) == (wanted, bool(wanted)), cases[i]
    got = {r.datapack: {n for n in quality.RULES if r[n]} for r in quality.quality_rules(injections.where("i >= 90"), df).collect()}
    assert got == {"e": {"large_latency_normal"}, "f": {"duplicated_spans"}, "g": {"target_not_called"}}


def test_codes(spark):
    rows = [(1, '{"mem_type": 2, "body_type": "random", "return_type": 9, "replace_method": 6}'), (2, "{}"), (3, None)]
    got = {r.i: (r.mem_type, r.body_type, r.return_type, r.replace_method, r.has_point) for r in quality.injection_config(spark.createDataFrame(rows, "i int, display_config string")).collect()}
    assert got == {1: ("stack", "random", None, "PATCH", False), 2: (None, None, None, None, False), 3: (None, None, None, None, False)}
