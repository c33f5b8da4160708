"""The trace model: column names and fixed values that records share.

steps: run_id, pos, id, index, type, label, tool_name, started_at, duration_ms, tokens, cost, input, output,
data_payload, span_id, parent_span_id, hash, prev_hash, commitments, salts, redactions. A payload is JSON text;
SQL NULL means absent, the text `null` a present null.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the trace model.
STEP_TYPES = ("user_input", "plan", "llm_reasoning", "tool_call", "approval", "branch", "error", "final_output")
STATUSES = ("completed", "failed", "running")
WARNING_KINDS = ("loop", "high_cost_step", "error")
PAYLOADS = ("input", "output", "data_payload")
#: Name of each payload in a record's JSON.
JSON_NAMES = {"input": "input", "output": "output", "data_payload": "dataPayload"}
LOOP_LENGTH = 3
HIGH_COST = 3.0
HASH_VERSIONS = (1, 2)
STEP_TAG, RUN_TAG = "tgstep/2\0", "tgrun/2\0"

STEP_SCHEMA = (
    "run_id string, pos long, id string, index long, type string, label string, tool_name string, started_at string, duration_ms double, "
    "tokens double, cost double, input string, output string, data_payload string, span_id string, parent_span_id string, hash string, "
    "prev_hash string, commitments map<string,string>, salts map<string,string>, redactions array<struct<path:string,at:string,reason:string,by:string>>"
)
RUN_SCHEMA = "run_id string, name string, started_at string, ended_at string, status string, currency string"


@dataclass(frozen=True)
class Wire:
    """Names that a producer puts into its records; interoperating with one means passing its namespace."""

    namespace: str = "trace"

    @property
    def redacted(self) -> str:
        return f"[{self.namespace}:redacted]"

    def attribute(self, name: str) -> str:
        return f"{self.namespace}.{name}"
