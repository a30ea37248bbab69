"""What a run of calls to priced models could cost at worst, before it starts.

Every call is taken at its longest prompt and its full output.  Prices are columns, in dollars for a
million tokens; counts of cases and turns may be columns too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the estimates: characters a token, and of prompts beside the evidence.
CHARS_PER_TOKEN, GENERATION_CHARS, JUDGE_CHARS, CONDENSE_CHARS = 4, 2_000, 4_000, 8_000
AGENT_TOKENS, PLAN_TOKENS = 3_000, 1_000


class Model(NamedTuple):
    """Prices of a million tokens in and out, and the longest output in tokens."""

    given: Column
    made: Column
    longest: int


class Agent(NamedTuple):
    searches: int = 3
    calls: int = 8
    planned: bool = False
    checked: bool = False


def call_usd(model: Model, chars: int) -> Column:
    """One call: three characters count as a token, rounded up."""
    return (F.lit(-(-chars // 3)) * model.given + F.lit(model.longest) * model.made) / F.lit(1e6)


def _answer(model: Model, evidence: int) -> Column:
    return call_usd(model, evidence * CHARS_PER_TOKEN + GENERATION_CHARS)


def agent_usd(model: Model, evidence: int, agent: Agent) -> Column:
    """An agent's steps without its answer: each call carries all evidence so far; then the plan, and two checks with a rewrite and its repair."""
    out = F.lit(agent.calls) * call_usd(model, CHARS_PER_TOKEN * (evidence * (agent.searches + 1) + AGENT_TOKENS))
    out = out + call_usd(model, CHARS_PER_TOKEN * PLAN_TOKENS) if agent.planned else out
    return out + 4 * _answer(model, evidence) if agent.checked else out


def questions_usd(cases: Column, variants: int, model: Model, judge: Model, evidence: int, scorer: Model | None = None, agents: tuple[Agent, ...] = ()) -> Column:
    """Single questions: two answers and two verdicts for each case and variant, a faithfulness score, and what agents do on top."""
    each = 2 * _answer(model, evidence) + 2 * call_usd(judge, JUDGE_CHARS)
    each = each + _answer(scorer, evidence) if scorer else each
    out = cases * variants * each
    for agent in agents:
        out = out + cases * agent_usd(model, evidence, agent)
    return out


def turns_usd(turns: Column, modes: int, systems: tuple[Agent | None, ...], model: Model, judge: Model, evidence: int, scorer: Model | None = None) -> Column:
    """Turns of conversations in some modes, by pipelines (None: a condensing call first) and agents; two answers and a verdict each."""
    out = F.lit(0.0)
    for system in systems:
        steps = call_usd(model, CONDENSE_CHARS) if system is None else agent_usd(model, evidence, system)
        each = steps + 2 * _answer(model, evidence) + call_usd(judge, JUDGE_CHARS)
        out = out + turns * modes * (each + _answer(scorer, evidence) if scorer else each)
    return out


def conversations_usd(conversations: Column, model: Model, judge: Model, evidence: int, history: int = CONDENSE_CHARS) -> Column:
    """Two-turn conversations in three conditions: twice a condensing call and four answers, and three verdicts."""
    return conversations * ((call_usd(model, history) + 4 * _answer(model, evidence)) * 2 + 3 * call_usd(judge, JUDGE_CHARS))
