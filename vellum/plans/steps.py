"""A declarative program of document steps, compiled to one chain of column expressions.

A step transforms the current text, may decide the document's class (branching), may stop the
document by its output, may need context. Phases: universal steps, then those of the document's
class, then the closing ones; within a phase by order. All documents run in one plan without
shuffles: the class picks by `when`, and every step leaves a struct in the log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.documents import branch_value, stops
from vellum.functions.redaction import masked

#: What a step does with a text, by name.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "same": lambda t: t,
    "trim": lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")),
    "redact": masked,
    "first_words": lambda t: F.array_join(F.slice(F.split(t, " "), 1, 20), " "),
    "length_gate": lambda t: F.when(F.length(t) < 40, "NICHT_MEDIZINISCH zu kurz").otherwise("MEDIZINISCH"),
    "class_by_length": lambda t: F.when(F.length(t) > 4000, "Klasse: LANG").otherwise("Klasse: KURZ"),
    "upper": F.upper,
    "lower": F.lower,
}


@dataclass(frozen=True)
class Step:
    name: str
    order: int
    transform: str
    document_class: str | None = None
    post_branching: bool = False
    branching: bool = False
    classes: tuple[str, ...] = ()
    stop_on: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    language: str | None = None
    enabled: bool = True
    append: bool = False
    replaces: bool = True


@dataclass
class Program:
    steps: list[Step] = field(default_factory=list)

    def ordered(self, language: str | None = None) -> list[Step]:
        """Enabled steps of a language by phase (universal, class, closing), then order."""
        kept = [s for s in self.steps if s.enabled and s.language in (None, language)]
        return sorted(kept, key=lambda s: (3 if s.post_branching else 2 if s.document_class else 1, s.order))


def run(docs: DataFrame, program: Program, language: str | None = None, context: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, output, document_class, status, stopped_at, log.

    A step whose required context column is null is skipped; after a stop nothing runs; a branching or
    gating step's output is logged but does not replace the text.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.lit(None).cast("string").alias("_class"), F.lit(None).cast("string").alias("_stop"), *context)
    log = []
    for i, s in enumerate(program.ordered(language)):
        there = F.lit(True)
        for name in s.requires:
            there = there & (F.col(name).isNotNull() if name in context else F.lit(False))
        mine = F.col("_class").eqNullSafe(s.document_class) if s.document_class else F.lit(True)
        runs = F.col("_stop").isNull() & mine
        # output and status are columns until the log: out of a struct, their expressions would be repeated wherever a field of it is read
        output, state = F.col(f"_o{i}"), F.col(f"_st{i}")
        rows = rows.withColumn(f"_o{i}", F.when(runs & there, TRANSFORMS[s.transform](F.col("_text"))))
        status = F.when(~runs, None).when(~there, "SKIPPED")
        rows = rows.withColumn(f"_st{i}", (status.when(stops(output, list(s.stop_on)), "TERMINATED") if s.stop_on else status).otherwise("COMPLETED"))
        done = F.coalesce(state == "COMPLETED", F.lit(False))
        updates = {}
        if s.branching:
            updates["_class"] = F.when(done, branch_value(output, list(s.classes))).otherwise(F.col("_class"))
        elif s.replaces and not s.stop_on:
            updates["_text"] = F.when(done, F.concat(F.col("_text"), F.lit("\n"), output) if s.append else output).otherwise(F.col("_text"))
        if s.stop_on:
            updates["_stop"] = F.coalesce("_stop", F.when(state == "TERMINATED", F.lit(s.name)))
        if updates:
            rows = rows.withColumns(updates)
        log.append(F.struct(F.lit(s.name).alias("step"), F.lit(i).alias("position"), state.alias("status"), output.alias("output")))
    entries = F.filter(F.array(*log), lambda x: x["status"].isNotNull())
    return rows.select("doc_id", F.col("_text").alias("output"), F.col("_class").alias("document_class"), F.when(F.col("_stop").isNull(), "COMPLETED").otherwise("TERMINATED").alias("status"), F.col("_stop").alias("stopped_at"), entries.alias("log"))


def step_log(done: DataFrame) -> DataFrame:
    """One row per step that ran or was skipped.

    The outer form, as the inner one lets Spark infer that the log is not empty and test that, all steps written out, on the scan."""
    return done.select("doc_id", F.inline_outer("log")).where("step is not null")


LETTERS = Program(
    [
        Step("gate", 1, "length_gate", stop_on=("NICHT_MEDIZINISCH",)),
        Step("redact", 2, "redact"),
        Step("classify", 3, "class_by_length", branching=True, classes=("LANG", "KURZ")),
        Step("shorten", 10, "first_words", document_class="LANG"),
        Step("soften", 10, "lower", document_class="KURZ"),
        Step("with source", 15, "same", post_branching=True, requires=("source",)),
        Step("with nothing", 16, "same", post_branching=True, requires=("missing",)),
        Step("tidy", 20, "trim", post_branching=True),
        Step("german only", 21, "upper", post_branching=True, language="de"),
        Step("disabled", 22, "upper", enabled=False),
    ]
)
