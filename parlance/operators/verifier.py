"""Rounds between a verifier and a proposer over uncertain candidates.

A candidate is a small state machine: the verifier may look things up in the meeting, then gives a
verdict; unless it keeps the candidate, the proposer answers, and accepts, amends or defends. Each
candidate gives exactly one record. Candidates are independent, so they run in ``mapInPandas``
with their topic's and meeting's turns beside them.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import PRONOUNS, STOPWORDS, VAGUE_ACTORS
from parlance.operators import actors
from parlance.operators.ports import LLM

# --- fixed values -----------------------------------------------------------------------------
ROUNDS, LOOKUPS, TOP_K, MAX_TURN, MAX_ONE, LEAD = 3, 3, 5, 600, 3000, 120
# -----------------------------------------------------------------------------------------------


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def _terms(text: str) -> Counter:
    w = _words(text)
    out = Counter(x for x in w if x not in STOPWORDS)
    out.update(f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if not (a in STOPWORDS and b in STOPWORDS))
    return out


class MeetingTools:
    """Read-only lookups in one meeting: a turn, a search, whom a name may mean.

    ``roster`` lists whom the meeting knows: name, kind and aliases. Speakers are known as well.
    """

    def __init__(self, turns: list[dict], roster: list[dict] | None = None) -> None:
        self.turns = turns
        self.roster = list(roster or [])
        listed = {actors.plain_key(r["name"]) for r in self.roster}
        for name in dict.fromkeys(t["speaker"] for t in turns if t["speaker"]):
            if actors.plain_key(name) not in listed:
                self.roster.append({"name": name, "kind": "person", "aliases": []})
        self._terms = [_terms(t["text"]) for t in turns]
        self._size = [sum(n for w, n in c.items() if " " not in w) for c in self._terms]
        self._mean = sum(self._size) / len(self._size) if turns else 1.0
        self._df = Counter(w for c in self._terms for w in c)

    def find(self, raw: str) -> dict | None:
        """A turn by its id, or by the number at its end if only one has it."""
        for t in self.turns:
            if t["turn_id"] == raw:
                return t
        n = re.search(r"(\d+)\D*$", raw or "")
        same = [t for t in self.turns if n and re.search(r"(\d+)\D*$", t["turn_id"]) and int(re.search(r"(\d+)\D*$", t["turn_id"]).group(1)) == int(n.group(1))]
        return same[0] if len(same) == 1 else None

    def line(self, turn: dict, most: int, terms: Counter | None = None) -> str:
        text = turn["text"]
        if len(text) > most and terms:
            at = [text.lower().find(w) for w in terms if text.lower().find(w) >= 0]
            lo = max(0, min(at) - LEAD) if at else 0
            text = ("…" if lo else "") + text[lo : lo + most]
        return f"[{turn['turn_id']}|{turn['speaker'] or '?'}] {text[:most]}"

    def search(self, query: str, k: int = TOP_K) -> list[dict]:
        """The ``k`` best turns by BM25, in the meeting's order."""
        n, scored = len(self.turns), []
        asked = _terms(query)
        for i, terms in enumerate(self._terms):
            score = 0.0
            for w in asked:
                tf = terms.get(w, 0)
                if tf:
                    idf = math.log(1 + (n - self._df[w] + 0.5) / (self._df[w] + 0.5))
                    score += (2.0 if " " in w else 1.0) * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * self._size[i] / max(self._mean, 1e-9)))
            if score > 0:
                scored.append((-score, i))
        return [self.turns[i] for i in sorted(i for _, i in sorted(scored)[:k])]

    def candidates(self, said: str, turn: dict | None = None, self_committed: bool = False) -> list[tuple[float, str, str]]:
        """(score, name, kind) of everyone whom a name may mean, best first: by the roster's rules, and by who speaks in the turn and after it."""
        alias, found = actors.plain_key(said), []
        place = self.turns.index(turn) if turn else None
        after = self.turns[place + 1]["speaker"] if turn and place + 1 < len(self.turns) else None
        mine, theirs = (actors.plain_key(x) if x else None for x in (turn["speaker"] if turn else None, after))
        for r in self.roster:
            keys = [actors.plain_key(n) for n in (r["name"], *(r["aliases"] or []))]
            score = 0.0
            if alias in keys:
                score = actors.FULL
            elif r["kind"] == "person":
                score = actors.GIVEN if keys[0].endswith(f" {alias}") else 0.0
            elif any((" " in alias and alias in k) or (" " in k and k in alias) for k in keys):
                score = actors.PARTIAL_ORG
            if not score:
                continue
            if r["kind"] == "person" and keys[0] == mine:
                score += actors.SELF_COMMIT if self_committed else actors.ASSIGNER
            elif r["kind"] == "person" and keys[0] == theirs:
                score += actors.RESPONDER
            found.append((round(min(1.0, max(0.0, score)), 2), r["name"], r["kind"]))
        return sorted(found, key=lambda x: (-x[0], x[2], x[1]))

    def lookup(self, argument: str) -> str:
        """Whom "name" or "name @turn" may mean, a line each, and whether one is clear."""
        alias, _, turn = argument.partition("@")
        if not alias.strip():
            return "no name before @"
        at = self.find(turn.strip()) if turn.strip() else None
        if turn.strip() and not at:
            return "no such turn"
        found = self.candidates(alias, at)
        if not found:
            return f"nobody is called {alias.strip()}; known: {', '.join(r['name'] for r in self.roster) or 'nobody'}"
        clear = found[0][0] >= actors.CLEAR_SCORE and round(found[0][0] - (found[1][0] if len(found) > 1 else 0.0), 2) >= actors.CLEAR_MARGIN
        return "\n".join([*(f"{name} | {kind} | {score:.2f}" for score, name, kind in found), f"clear: {found[0][1]}" if clear else "ambiguous"])

    def run(self, action: str, argument: str) -> str:
        if action == "get_turn":
            turn = self.find(argument)
            return self.line(turn, MAX_ONE) if turn else "no such turn"
        if action == "search_meeting":
            found = self.search(argument)
            return "\n".join(self.line(t, MAX_TURN, _terms(argument)) for t in found) or "nothing found"
        if action == "lookup_speaker":
            return self.lookup(argument)
        return "no such tool"


def settle_verdict(verdict: str | None, kind: str, deciding_turn: str | None, known: set[str], actor: str | None) -> tuple[str, str | None]:
    """A verdict that holds, and the actor: keeping needs a real deciding turn, a decision isn't revised, nobody is vague."""
    if verdict not in ("keep", "drop", "revise"):
        return "unresolved", actor
    if verdict != "drop" and deciding_turn not in known:
        return "drop", actor
    if verdict == "revise" and kind == "decision":
        verdict = "keep"
    nobody = actor is None or actor.strip().lower() in {*PRONOUNS, *VAGUE_ACTORS}
    return verdict, None if nobody else actor


@dataclass
class Record:
    candidate_id: str
    outcome: str = "fallback"
    kept: bool = True
    text: str = ""
    actor: str | None = None
    rounds: list[dict] = field(default_factory=list)
    error: str | None = None


def verify(candidate: dict, tools: MeetingTools, llm: LLM, rounds: int = ROUNDS, lookups: int = LOOKUPS) -> Record:
    """One candidate (candidate_id, kind, text, actor, evidence) through all rounds; never raises."""
    known = {t["turn_id"] for t in tools.turns}
    now = {"text": candidate["text"], "actor": candidate.get("actor")}
    record = Record(candidate["candidate_id"], text=now["text"], actor=now["actor"])
    last: tuple[str, str | None] = ("unresolved", now["actor"])
    try:
        for _ in range(rounds):
            steps, step = [], {}
            for call in range(lookups + 1):
                prompt = json.dumps({"candidate": candidate | now, "rounds": record.rounds, "steps": steps, "must_decide": call == lookups}, ensure_ascii=False)
                step = llm.generate_json("verify", prompt, {})
                if step.get("action") in ("get_turn", "search_meeting", "lookup_speaker") and call < lookups:
                    again = any(s["action"] == step["action"] and s["argument"] == step.get("argument") for s in steps)
                    steps.append({"action": step["action"], "argument": step.get("argument"), "observation": "already looked up" if again else tools.run(step["action"], str(step.get("argument") or ""))})
                    continue
                break
            turn = tools.find(str(step.get("deciding_turn_id") or ""))
            last = settle_verdict(step.get("verdict"), candidate["kind"], turn["turn_id"] if turn else None, known, step.get("revised_actor") or now["actor"])
            record.rounds.append({"verdict": last[0], "reasoning": step.get("reasoning"), "steps": steps})
            if last[0] == "keep":
                record.outcome, record.text, record.actor = "consensus", now["text"], last[1]
                return record
            reply = llm.generate_json("feedback", json.dumps({"candidate": candidate | now, "verdict": last[0], "rounds": record.rounds}, ensure_ascii=False), {})
            stance = reply.get("stance")
            record.rounds[-1]["stance"] = stance
            if stance == "accept":
                if last[0] == "revise":
                    record.outcome, record.text, record.actor = "consensus", now["text"], last[1]
                    return record
                if not defends(reply, tools, llm):
                    record.outcome, record.kept = "consensus", False
                    return record
            elif stance == "amend":
                now = {"text": (reply.get("revised_text") or now["text"]).strip() or now["text"], "actor": reply.get("revised_actor") or now["actor"]}
        if last[0] == "unresolved":
            return record
        record.outcome, record.kept, record.text, record.actor = "verifier", last[0] != "drop", now["text"], last[1]
    except Exception as error:
        record.outcome, record.kept, record.text, record.actor, record.error = "fallback", True, candidate["text"], candidate.get("actor"), f"{type(error).__name__}: {error}"
    return record


def defends(reply: dict, tools: MeetingTools, llm: LLM) -> bool:
    """Whether an acceptance argues the other way; a failing check leaves it as it was."""
    argument = str(reply.get("argument") or "")
    if not argument.strip():
        return False
    cited = [tools.line(t, MAX_TURN) for t in map(tools.find, dict.fromkeys(re.findall(r"TURN_\d{6}", argument))) if t]
    try:
        return llm.generate_json("stance", json.dumps({"argument": argument, "turns": cited}, ensure_ascii=False), {}).get("stance") == "defend"
    except Exception:
        return False


def verified(candidates: DataFrame, turns: DataFrame, make: Callable[[], LLM], rounds: int = ROUNDS, roster: DataFrame | None = None) -> DataFrame:
    """A record for every candidate (meeting_id, candidate_id, kind, text, actor): outcome, kept, text, actor, rounds (JSON), error.

    ``roster``: meeting_id, name, kind, aliases of whom the meetings know.
    """
    meeting = turns.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "turn_id", "speaker", F.col("text_exact").alias("text")))).alias("turns"))
    if roster is not None:
        listed = roster.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("name", "kind", F.to_json("aliases").alias("aliases")))).alias("roster"))
        meeting = meeting.join(listed, "meeting_id", "left")
    else:
        meeting = meeting.withColumn("roster", F.lit(None).cast("array<struct<name: string, kind: string, aliases: string>>"))
    kind = dict(candidates.dtypes)["meeting_id"]

    def dicts(rows) -> list[dict]:
        return [dict(t) if isinstance(t, dict) else t.asDict() for t in (rows if rows is not None else [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        llm, cache = make(), {}
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                if row["meeting_id"] not in cache:
                    cache.clear()
                    known = [r | {"aliases": json.loads(r["aliases"] or "[]")} for r in dicts(row["roster"])]
                    cache[row["meeting_id"]] = MeetingTools(dicts(row["turns"]), known)
                r = verify({k: row[k] for k in ("candidate_id", "kind", "text", "actor")}, cache[row["meeting_id"]], llm, rounds)
                out.append((row["meeting_id"], r.candidate_id, r.outcome, r.kept, r.text, r.actor, json.dumps(r.rounds, ensure_ascii=False), r.error))
            yield pd.DataFrame(out, columns=["meeting_id", "candidate_id", "outcome", "kept", "text", "actor", "rounds", "error"])

    rows = candidates.select("meeting_id", "candidate_id", "kind", "text", "actor").join(meeting, "meeting_id", "left")
    return rows.sortWithinPartitions("meeting_id").mapInPandas(run, f"meeting_id {kind}, candidate_id string, outcome string, kept boolean, text string, actor string, rounds string, error string")
