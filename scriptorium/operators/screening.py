"""Abstract screening with a user-supplied text model: a multiple-choice cascade.

A cascade is a declared list of questions.  Each step asks its question for all
rows that are still open, in batches, and matches the answers against the
choices with a column expression; the answer decides whether the row stays open
for the next step.

Answers are kept in a table by the digest of their prompt, written step by step
(or in several waves a step).  A prompt that has an answer is not asked again,
by other rows with the same prompt or by a job that goes on after another died;
failures are kept for the report and asked again by the next job.  Only row
numbers, digests and prompts cross a step: titles and abstracts stay where they
were written once, and the answers are joined to them at the end.

The model is any callable ``predict(prompts) -> responses`` over a list of
prompts (lists of role/content messages); a factory builds it at the start of
each task.  Where a batch raises or gives another number of answers, its halves
are asked, so a failing row is reported in ``error`` and the others go on.
Earlier results are brought back by DOI so only pending articles reach the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import checkpoint_root, scratch_dir
from scriptorium.sources import generations

# System messages, questions and their choices.
SYSTEM_INTRO = (
    "You are an accurate AI assistant answering Multiple-Choices questions on research papers. "
    "Your answers are always one of the provided choices."
)
SYSTEM_EXAMPLES = "Here are some examples of conversations."
SYSTEM_SEPARATOR = "---"
SYSTEM_READY = "You are now ready to answer questions about the abstracts of research papers."
OTHER = "other"
LANGUAGES = ("English", "Chinese", "German", OTHER)
IMAGE_TYPES = ("color fundus", "OCT or OCTA", "angiography or angiograms", "slit lamp", "ultrasound", "3D images", "MR", "CT")
CONTRIBUTIONS = (
    "review other research papers",
    "novel segmentation method",
    "novel artery and vein classification method",
    "novel diagnosis method",
)
STRUCTURES = ("optic disc", "macula or fovea", "retinal vessels", "arteries and veins", "lesions", "microaneurysms or hemorrhages")
FLAG_COLUMNS = ("fundus_vessel_segmentation", "fundus_vessel_classification")

Message = dict[str, str]
Model = Callable[[list[list[Message]]], list[str]]


@dataclass(frozen=True)
class Question:
    """One step: its answer column, wording, choices, and what an answer leads to.

    A row stays open while its answer contains ``goes_on``, unless the answer
    contains ``flag_word``, which sets ``flag`` and ends the row.
    """

    column: str
    wording: str
    choices: tuple[str, ...]
    goes_on: str | None = None
    flag: str | None = None
    flag_word: str | None = None

    def message(self, subject: str = "USER PAPER", wording: str | None = None) -> Message:
        listed = (*(c for c in self.choices if c != OTHER), OTHER)
        return {"role": "user", "content": "\n".join([(wording or self.wording).format(subject), *listed])}


CASCADE = (
    Question("language", "Which language is mostly used in the {}?", LANGUAGES, goes_on="English"),
    Question("image", "Which type of images is mostly used in {}?", IMAGE_TYPES, goes_on="color fundus"),
    Question(
        "contribution", "Which sentence best describes the contribution of {}?", CONTRIBUTIONS,
        goes_on="segmentation", flag="fundus_vessel_classification", flag_word="artery and vein",
    ),
    Question(
        "structure", "Which structure is segmented by the method proposed in {}?", STRUCTURES,
        flag="fundus_vessel_segmentation", flag_word="vessels",
    ),
)
ANSWER_COLUMNS = tuple(q.column for q in CASCADE)
BY_COLUMN = {q.column: q for q in CASCADE}
# Fixed value: how an example asks for the language.
EXAMPLE_LANGUAGE = "Which language is mostly used in the paper?"


def example_dialogue(k: int, title: str, abstract: str, answers: Sequence[tuple[str, str]]) -> list[Message]:
    """Few-shot example: the paper, then (answer column, answer) pairs in order."""
    name = f"EXAMPLE PAPER {k}"
    messages = [{"role": "user", "content": f"{name}: {title}\n{abstract}"}]
    for column, answer in answers:
        wording = EXAMPLE_LANGUAGE if column == "language" else None
        messages += [BY_COLUMN[column].message(name, wording), {"role": "agent", "content": answer}]
    return messages


def last_words(c: Column, n: int | None = None) -> Column:
    """The space-separated words of a text (tabs removed, empty words dropped), the last ``n`` only if given."""
    words = F.filter(F.split(F.replace(c, F.lit("\t"), F.lit("")), " "), lambda w: w != "")
    if n is not None:
        words = F.when(F.size(words) <= n, words).otherwise(F.slice(words, -n, n))
    return F.array_join(words, " ")


def match_choice(response: Column, choices: Sequence[str]) -> Column:
    """First choice (list order, then ``other``) contained in the response, case-free;
    else the lower-cased response stripped of quotes, dots and spaces."""
    r = F.lower(response)
    out = F.regexp_replace(r, r'^[". ]+|[". ]+$', "")
    for c in reversed([*choices, OTHER]):
        out = F.when(r.contains(c.lower()), F.lit(c)).otherwise(out)
    return out


def user_paper(title_col: str, abstract_col: str, n_words: int | None) -> Column:
    return F.concat(F.lit("USER PAPER:"), F.col(title_col), F.lit(".\n"), last_words(F.col(abstract_col), n_words))


def build_prompt(
    df: DataFrame, title_col: str = "title", abstract_col: str = "abstract", n_words: int | None = None
) -> DataFrame:
    """Adds ``user_paper``, the user message of the prompt: title and abstract, of
    which the last ``n_words`` words only if given."""
    return df.withColumn("user_paper", user_paper(title_col, abstract_col, n_words))


def prompt_messages(
    question: Message, title_col: str = "title", abstract_col: str = "abstract", few_shot=(), n_words: int | None = None
) -> Column:
    """The full chat prompt of one question as an ``array<struct<role, content>>`` column:
    system messages and few-shot dialogues (literals), the user's paper, then the question."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def fixed(*texts: str) -> list[Column]:
        return [message("system", F.lit(t)) for t in texts]

    examples = [message(m["role"], F.lit(m["content"])) for dialogue in few_shot for m in dialogue]
    paper = message("user", user_paper(title_col, abstract_col, n_words))
    asked = message(question["role"], F.lit(question["content"]))
    return F.array(*fixed(SYSTEM_INTRO, SYSTEM_EXAMPLES), *examples, *fixed(SYSTEM_SEPARATOR, SYSTEM_READY), paper, asked)


# Prompts given to the model at a time.
BATCH_SIZE = 64


def _ask(model: Model, prompts: list[list[Message]]) -> list[tuple[str | None, str | None]]:
    """(response, error) of each prompt: the batch at once, or its halves where that fails."""
    try:
        found = list(model(prompts))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
        return [(r, None) for r in found]
    except Exception as e:  # noqa: BLE001 - reported per row
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(prompts) // 2
        return _ask(model, prompts[:half]) + _ask(model, prompts[half:])


def answer_prompts(
    df: DataFrame, model_factory: Callable[[], Model], messages_col: str = "messages", batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Adds ``response`` and ``error``: the model's answer to each row's prompt, ``batch_size`` prompts at a time."""
    from scriptorium.session import ship_package

    ship_package(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            prompts = [[{"role": m["role"], "content": m["content"]} for m in row] for row in pdf[messages_col]]
            found = [x for at in range(0, len(prompts), batch_size) for x in _ask(model, prompts[at : at + batch_size])]
            yield pdf.assign(response=[r for r, _ in found], error=[e for _, e in found])

    return df.mapInPandas(run, f"{schema}, response string, error string")


ANSWERS = "digest string, response string, error string"


def prompt_digest(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def known_answers(spark: SparkSession, path: str) -> DataFrame:
    """``digest, response, error``: one row per prompt asked so far; the latest error where none was answered."""
    paths = [g.path for g in generations.live(spark, path)]
    if not paths:
        return spark.createDataFrame([], ANSWERS)
    rows = spark.read.schema(ANSWERS).parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))
    order = F.struct(F.col("error").isNull(), F.col("_file"))
    return rows.groupBy("digest").agg(F.max_by(F.struct("response", "error"), order).alias("a")).select("digest", "a.*")


def ask_new(prompts: DataFrame, path: str, model_factory: Callable[[], Model], batch_size: int = BATCH_SIZE, waves: int = 1) -> None:
    """Ask the prompts (``digest, messages``) that have no answer below ``path`` yet, each once, and keep the answers.

    With several ``waves`` the prompts are dealt by digest, and each wave is kept before the next is asked.
    """
    spark = prompts.sparkSession
    for wave in range(waves):
        dealt = prompts.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave) if waves > 1 else prompts
        answered = known_answers(spark, path).where("error IS NULL").select("digest")
        new = dealt.join(answered, "digest", "left_anti").groupBy("digest").agg(F.any_value("messages").alias("messages"))
        found = answer_prompts(new, model_factory, batch_size=batch_size).select("digest", "response", "error")
        generations.add(spark, path, lambda folder, found=found: found.write.mode("append").parquet(folder))


def screen_abstracts(
    df: DataFrame,
    model_factory: Callable[[], Model],
    title_col: str = "title",
    abstract_col: str = "abstract",
    few_shot=(),
    n_words: int | None = None,
    cascade: Sequence[Question] = CASCADE,
    answers_path: str | None = None,
    batch_size: int = BATCH_SIZE,
    waves: int = 1,
) -> DataFrame:
    """Adds the answer columns, the flags and ``error`` to every row of ``df``.

    A row whose question failed has an error and no answers.  ``answers_path``
    is the folder of the answer table of this model; without one, a fresh
    scratch folder is used.
    """
    spark = df.sparkSession
    path = answers_path or scratch_dir(spark, "answers")
    checkpoint_root(spark)
    answers = [q.column for q in cascade]
    flags = [q.flag for q in cascade if q.flag]
    kept = [c for c in df.columns if c not in (*answers, *flags, "error")]
    rows = df.select(*kept, F.monotonically_increasing_id().alias("_row")).checkpoint()
    open_rows = rows.select("_row")
    steps = None
    for q in cascade:
        prompt = prompt_messages(q.message(), title_col, abstract_col, few_shot, n_words)
        asking = rows.join(open_rows, "_row", "left_semi").select("_row", prompt.alias("messages"))
        asking = asking.withColumn("digest", prompt_digest(F.col("messages")))
        ask_new(asking.select("digest", "messages"), path, model_factory, batch_size, waves)
        ok, answer = F.col("error").isNull(), match_choice(F.col("response"), q.choices)
        told = asking.select("_row", "digest").join(known_answers(spark, path), "digest")
        step = told.select("_row", F.lit(q.column).alias("column"), F.when(ok, answer).alias("answer"), "error").checkpoint()
        flagged = F.lit(False) if q.flag is None else F.col("answer").contains(q.flag_word)
        goes_on = F.lit(False) if q.goes_on is None else F.col("answer").contains(q.goes_on) & ~flagged
        open_rows = step.where(goes_on).select("_row")
        steps = step if steps is None else steps.unionByName(step)
    of = lambda q: F.max(F.when(F.col("column") == q.column, F.col("answer")))
    gathered = steps.groupBy("_row").agg(*[of(q).alias(q.column) for q in cascade], F.max("error").alias("error"))
    ok = F.col("error").isNull()
    result = rows.join(gathered, "_row", "left")
    by_flag = {q.flag: F.when(ok, F.coalesce(F.col(q.column).contains(q.flag_word), F.lit(False))) for q in cascade if q.flag}
    ordered = [*[c for c in FLAG_COLUMNS if c in flags], *[c for c in flags if c not in FLAG_COLUMNS]]
    return result.select(
        *kept, *[F.when(ok, F.col(c)).alias(c) for c in answers], *[by_flag[c].alias(c) for c in ordered], "error"
    )


def resume_screening(articles: DataFrame, previous: DataFrame | None, key: str = "doi") -> DataFrame:
    """Bring earlier answers by key (missing answer columns are added as NULL).

    Of several earlier rows of a key an answered one wins, then the smallest in
    order of its answers and flags.
    """
    cols = [*ANSWER_COLUMNS, *FLAG_COLUMNS]
    kinds = {c: "boolean" if c in FLAG_COLUMNS else "string" for c in cols}
    if previous is None:
        return articles.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in cols])
    prev = previous
    for c in cols:
        if c not in prev.columns:
            prev = prev.withColumn(c, F.lit(None).cast(kinds[c]))
    order = F.struct(F.col("language").isNull(), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    prev = prev.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")
    return articles.drop(*[c for c in cols if c in articles.columns]).join(prev, key, "left")


def pending(df: DataFrame) -> DataFrame:
    """Articles without an answer yet."""
    return df.where(F.col("language").isNull())


def analyse_abstracts(
    articles: DataFrame, previous: DataFrame | None, model_factory, key: str = "doi", few_shot=(), n_words: int | None = None, **asking
) -> DataFrame:
    """Resume, screen the pending articles, and return all articles with answers."""
    resumed = resume_screening(articles, previous, key).withColumn("error", F.lit(None).cast("string"))
    done = resumed.where(F.col("language").isNotNull())
    return done.unionByName(screen_abstracts(pending(resumed), model_factory, few_shot=few_shot, n_words=n_words, **asking))


def screening_report(results: DataFrame) -> DataFrame:
    """``status, n``: articles answered (``analysed``), failed (``error`` set), still pending."""
    status = (
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when(F.col("language").isNull(), F.lit("pending"))
        .otherwise(F.lit("analysed"))
    )
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
