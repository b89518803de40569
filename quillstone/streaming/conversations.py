"""Conversations as a stream: each session's focus, pending clarification and last evidence are state that goes from batch to batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversation import CONTEXT_SOURCES, FOCUS_SLOTS, LOW_CONFIDENCE, RESULT, TURN_TYPES, prepared

_START = {"place": None, "before": None, "content": None, "found": None, "type": None, "turns": 0, "pending": None, "focus": None, "evidence": False}


def routed(row: dict, state: dict) -> dict:
    """The route of a question in a session's state: conversation.with_policy() for one row."""
    asked, refs = row["content"] or "", list(row["history_refs"])
    pending, focus = state["pending"], state["focus"]
    out = {"context_source": "none", "should_use_history": False, "effective_question": asked, "refs": [], "missing": [], "confidence": 1.0, "requires_clarification": False, "policy_reason": "new_session_fast_path", "turn_type": "new_rag_query"}
    if not (state["turns"] or pending or focus or state["evidence"]):
        return out
    kind = row["proposed_type"] if row["proposed_type"] in TURN_TYPES else "new_rag_query"
    source = row["proposed_source"] if row["proposed_source"] in CONTEXT_SOURCES else "none"
    question = row["proposed_question"] or asked
    out |= {"effective_question": question, "missing": list(row["missing_info"]), "confidence": row["confidence"], "policy_reason": None}

    def used(kind: str, source: str, refs: list, history: bool = True) -> dict:
        return {"turn_type": kind, "context_source": source, "should_use_history": history, "refs": refs}

    if 0 < row["confidence"] < LOW_CONFIDENCE:
        low = used("clarification_reply", "clarification_pending", refs) if pending else used("new_rag_query", "none", refs, False)
        return out | low | {"requires_clarification": True, "policy_reason": "turn_router_low_confidence", "missing": out["missing"] or ["conversation_context"]}
    if kind == "clarification_reply" and pending:
        joined = f"{pending['question'] or ''} {asked}".strip() if question == asked else question
        return out | used(kind, "clarification_pending", refs or [f"turn_{pending['turn']}"]) | {"effective_question": joined}
    if kind == "follow_up" and (focus or refs):
        return out | (used(kind, "conversation_focus", refs or ["focus"]) if focus else used(kind, source, refs, bool(row["proposed_history"])))
    if kind == "citation_followup" and state["evidence"]:
        return out | used(kind, "last_evidence", refs or ["last_evidence"])
    if kind == "meta_question":
        return out | used(kind, "recent_history" if source == "none" else source, refs)
    return out | {"refs": refs if kind in ("clarification_reply", "citation_followup") else []}


def answered(row: dict, state: dict) -> dict:
    """What a turn's answer makes of the state: its number and status, and the focus after it."""
    state["turns"] += 1
    decision = {"clarify": "clarification_pending", "answer": "completed", "refuse": "refused"}.get(row["decision"], "unknown")
    topic = row["effective_question"] or state["content"]
    own = row["found"]
    found = own if row["effective_question"] else {k: own[k] if own.get(k) is not None and k != "years" else state["found"].get(k) for k in ("years", *FOCUS_SLOTS)}
    state["pending"] = {"turn": state["turns"], "question": topic} if decision == "clarification_pending" else None
    if decision in ("completed", "unknown"):
        focus = dict(state["focus"] or {}) if state["type"] != "new_rag_query" else {}
        focus |= {"active_topic": topic, "last_query_type": row["query_type"], "updated_at": row["place"]}
        focus |= {k: v for k, v in found.items() if v is not None}
        state["focus"] = focus | ({"doc_scope": list(row["doc_sources"])} if len(row["doc_sources"]) else {})
    return {"turn": state["turns"], "status": decision}


def stepped(row: dict, state: dict) -> dict:
    """The result of a message, with the state moved on."""
    user = row["role"] == "user"
    out = dict.fromkeys(RESULT)
    if user:
        out |= routed(row, state) | {"pending_turn": state["pending"] and state["pending"]["turn"]}
        state |= {"content": row["content"], "found": row["found"], "type": out["turn_type"]}
    elif state["before"] == "user":
        out |= answered(row, state)
    if not user:
        state["evidence"] = bool(len(row["doc_sources"]) or row["n_citations"] > 0)
    state |= {"before": row["role"], "place": row["place"]}
    return out | {"focus": state["focus"] and {k: state["focus"].get(k) for k in ("active_topic", "last_query_type", "updated_at", "years", "doc_scope", *FOCUS_SLOTS)}}


class Conversation(StatefulProcessor):
    """One value of state a session. A message at or before the last place is a repeat, and gives nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        state = json.loads(held[0]) if held else dict(_START)
        found = [r for batch in rows for r in batch.to_dict("records")]  # a session's messages of one batch
        out = []
        for row in sorted(found, key=lambda r: (r["place"], r["role"] == "assistant")):
            if state["place"] is not None and (row["place"], row["role"] == "assistant") <= (state["place"], state["before"] == "assistant"):
                continue
            row = {k: None if isinstance(v, float) and pd.isna(v) else v for k, v in row.items()}
            row |= {c: [] if row[c] is None else list(row[c]) for c in ("history_refs", "missing_info", "doc_sources")}
            row |= {"place": int(row["place"]), "found": json.loads(row["found"]), "n_citations": row["n_citations"] or 0}
            result = stepped(row, state)
            out.append({"session_id": key[0], "place": row["place"], "role": row["role"], "result": json.dumps(result, ensure_ascii=False, default=str)})
        self.state.update((json.dumps(state, ensure_ascii=False),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_followed(messages: DataFrame) -> DataFrame:
    """conversation.followed() on a stream of messages that come in order; needs the RocksDB state store."""
    rows = prepared(messages).withColumn("found", F.to_json("found")).drop("missing_slots")
    kind, place = (messages.schema[c].dataType.simpleString() for c in ("session_id", "place"))
    out = rows.groupBy("session_id").transformWithStateInPandas(Conversation(), f"session_id {kind}, place {place}, role string, result string", "Append", "None")
    fields = F.from_json("result", ", ".join(f"{c} {t}" for c, t in RESULT.items()))
    return out.withColumn("result", fields).select("session_id", "place", "role", "result.*")
