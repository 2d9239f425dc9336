"""Prompt templates as ``concat`` expressions.

``concat`` rather than ``format_string``: data may contain ``%``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import DIMENSIONS
from .text import rtrim_ws, utrim

# The instruction template (header and section markers).
TEMPLATE_HEADER = ("Below is an instruction that describes a task. "
                   "If there is an input, it provides further context.")
SECTION_INSTRUCTION = "### Instruction:"
SECTION_INPUT = "### Input:"
SECTION_RESPONSE = "### Response:"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _body(instruction, input_) -> Column:
    return F.concat(F.lit(TEMPLATE_HEADER + "\n\n" + SECTION_INSTRUCTION + "\n"),
                    F.coalesce(_col(instruction), F.lit("")),
                    F.lit("\n\n" + SECTION_INPUT + "\n"), utrim(input_),
                    F.lit("\n\n" + SECTION_RESPONSE + "\n"))


def training_prompt(instruction, input_, output) -> Column:
    """Template with the expected output as the response."""
    return F.concat(_body(instruction, input_), F.coalesce(_col(output), F.lit("")))


def inference_prompt(instruction, input_) -> Column:
    """Template with an empty response, right-stripped, plus a newline."""
    return F.concat(rtrim_ws(_body(instruction, input_)), F.lit("\n"))


def dialogue_prompt(instruction, output) -> Column:
    """``User: {i}\\n\\nAssistant: {o}`` (input ignored)."""
    return F.concat(F.lit("User: "), _col(instruction), F.lit("\n\nAssistant: "), _col(output))


def plain_prompt(instruction, input_) -> Column:
    """C4: ``Instruction: …\\nInput: …\\n\\nOutput:``."""
    return F.concat(F.lit("Instruction: "), _col(instruction), F.lit("\nInput: "), _col(input_),
                    F.lit("\n\nOutput:"))


def teacher_prompt(instruction, input_) -> Column:
    """``instr\\n\\nInput: x`` when there is an input, else ``instr``."""
    i = F.coalesce(_col(input_), F.lit(""))
    return F.when(i != "", F.concat(_col(instruction), F.lit("\n\nInput: "), i)) \
            .otherwise(_col(instruction))


def message_list(system, user) -> Column:
    """``[{role: system}, {role: user}]``."""
    return F.array(F.struct(F.lit("system").alias("role"), _col(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), _col(user).alias("content")))


# The pairwise judge prompt (long form), section markers.
JUDGE_INTRO = "Please compare the following two responses to this instruction:"
JUDGE_TAIL = ("Please evaluate both responses and provide:\n"
              "1. Detailed scores for Response A on each dimension (1-5 scale)\n"
              "2. Detailed scores for Response B on each dimension (1-5 scale)\n"
              "3. Which response is better overall (A, B, or TIE)\n"
              "4. Brief justification for your decision\n"
              "\n"
              "Respond in the following JSON format:\n")


def _answer_format() -> str:
    """The JSON object a judge fills in: scores of both sides, winner, reason."""
    scores = [f'  "response_{s}_scores": {{\n' + ",\n".join(f'    "{d}": <1-5>' for d in DIMENSIONS) + "\n  }"
              for s in "ab"]
    rest = ['  "winner": "A" or "B" or "TIE"', '  "justification": "<brief explanation>"']
    return "{\n" + ",\n".join(scores + rest) + "\n}"


JUDGE_END = JUDGE_TAIL + _answer_format()


def judge_prompt(instruction, response_a, response_b) -> Column:
    """C8 long form, with the answer format that ``verdicts.parse_verdicts`` reads."""
    return F.concat(F.lit(JUDGE_INTRO + "\n\n### INSTRUCTION:\n"), _col(instruction),
                    F.lit("\n\n### RESPONSE A:\n"), _col(response_a),
                    F.lit("\n\n### RESPONSE B:\n"), _col(response_b),
                    F.lit("\n\n" + JUDGE_END))


def judge_prompt_short(instruction, response_a, response_b) -> Column:
    """C8 short form."""
    return F.concat(F.lit("Instruction: "), _col(instruction), F.lit("\n\nResponse A: "),
                    _col(response_a), F.lit("\n\nResponse B: "), _col(response_b))


# Markers a rendered prompt must contain (template check).
REQUIRED_MARKERS = ("Instruction:", "Input:", "Response:")


def template_ok(text) -> Column:
    """Every marker present."""
    t = _col(text)
    ok = F.lit(True)
    for m in REQUIRED_MARKERS:
        ok = ok & t.contains(m)
    return F.coalesce(ok, F.lit(False))
