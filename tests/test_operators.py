"""Operators on small inputs: edges, invariants, state."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import documents, guard, redaction, sequence, tables
from vellum.operators import costs, records
from vellum.streaming import limits


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_price_defaults(spark):
    logs = spark.createDataFrame([(1, "d", "m", 1000, 1000), (2, "d", "zero", 1000, 1000), (3, "d", None, 1000, 1000)], "id int, processing_id string, model_name string, input_tokens long, output_tokens long")
    models = spark.createDataFrame([("m", 1.0, 2.0), ("zero", 0.0, 2.0)], "name string, price_input double, price_output double")
    got = {r.id: round(r.total_cost, 8) for r in costs.priced(logs, models).collect()}
    assert got == {1: 0.003, 2: 0.00135, 3: 0.00135}


def test_empty_statistics(spark):
    logs = spark.createDataFrame([], "total_cost double, total_tokens long")
    r = costs.total_cost(logs).first()
    assert (r.total_cost, r.total_tokens, r.calls, r.avg_cost) == (0.0, 0, 0, 0.0)


def test_orphans_keep_null_keys(spark):
    steps = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, job_id int")
    jobs = spark.createDataFrame([(1,)], "job_id int")
    assert [r.id for r in records.orphans(steps, jobs).collect()] == [3]


def test_masking_is_idempotent(spark):
    texts = ["a.b@c.de, DE89 3704 0044 0532 0130 00", "+1 (555) 555-1234 and 10.0.0.1, 4111111111111111", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    first = redaction.with_counts(df)
    assert {r.id: r.masked for r in first.collect()} == {0: "[EMAIL], [IBAN]", 1: "[PHONE] and [IP], [CARD]", 2: "", 3: ""}
    assert [(r.n_email, r.n_iban, r.n_phone, r.n_ip, r.n_card) for r in first.orderBy("id").collect()] == [(1, 1, 0, 0, 0), (0, 0, 1, 1, 1), (0,) * 5, (0,) * 5]
    again = redaction.with_counts(first.select("id", F.col("masked").alias("text")))
    assert {r.id: r.masked for r in first.collect()} == {r.id: r.masked for r in again.collect()}


def test_cleanup(spark):
    before = "[NAME] [NAME] [NAME][PATIENT_NAME] 017470[PLZ_CITY] []x"
    df = spark.createDataFrame([(before,)], "t string").select("t", redaction.cleaned(F.col("t")).alias("c"))
    r = df.select("c", redaction.fixes(F.col("t"), F.col("c")).alias("n")).first()
    assert r.c == "[NAME] [PATIENT_NAME] [PHONE] x" and r.n > 0


def test_severity(spark):
    df = spark.createDataFrame([("act as",), ("show the prompt",), ("fine",), (None,)], "text string")
    assert [r.severity for r in guard.screened(df).collect()] == [1, 2, 0, 0]


def test_sanitize_full_width(spark):
    df = spark.createDataFrame([("a​b{｛",)], "text string")
    assert guard.sanitized(df).first().clean == "ab{{{"


def test_page_numbers_and_dates(spark):
    df = spark.createDataFrame([("Seite 4\n3.2.2020 und 2021-12-31, 99.99.2020",)], "t string")
    r = df.select(sequence.page_number(F.col("t")).alias("n"), sequence.dates(F.col("t")).alias("d")).first()
    assert r.n == 4 and [str(x) for x in r.d] == ["2020-02-03", "2021-12-31"]


def test_changes(spark):
    df = spark.createDataFrame([("a\nb", "a\nc\nd")], "a string, b string")
    r = df.select(documents.changes(F.col("a"), F.col("b")).alias("x")).first().x
    assert (r.change_count, r.length_diff, r.significant) == (2, 2, False)


def test_columns(spark):
    df = spark.createDataFrame([([100, 5, 20, 36, 140],)], "x array<int>")
    assert df.select(tables.column_starts(F.col("x")).alias("s")).first().s == [5, 36, 100, 140]


def test_penalties():
    state, outcomes = limits.State(), []
    for i in range(30):
        state, outcome, _ = limits.step(state, float(i), limits=(1, 50, 200))
        outcomes.append(outcome)
    assert outcomes[:2] == ["allowed", "minute"] and "temp_ban" in outcomes
    assert limits.violated(limits.State(violations=50, last_violation=0.0), 10.0).banned_until == -1.0
    assert limits.violated(limits.State(violations=10, last_violation=0.0), 10 * 86_400.0).violations == 8


def test_survivors_and_expired_partition_the_jobs(spark):
    jobs = spark.createDataFrame([(1, "2024-01-01 00:00:00", None), (2, "2024-01-30 23:30:00", False), (3, "2023-01-01 00:00:00", True), (4, "2024-01-01 00:00:00", True)], "job_id int, uploaded_at string, data_consent_given boolean").withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp_ntz"))
    now = "2024-01-31 00:00:00"
    gone = {r.job_id for r in records.expired(jobs, now).collect()}
    assert gone == {1, 3} and {r.job_id for r in records.survivors(jobs, now).collect()} == {2, 4}


def test_breaker(spark):
    rows = [("k", i, i == 0) for i in range(7)] + [("q", i, i % 2 == 0) for i in range(9)]
    got = limits.breaker(spark.createDataFrame(rows, "key string, seq int, ok boolean")).collect()
    assert [(r.key, r.failures, r.first) for r in got] == [("k", 6, 1)]


LETTERS = [
    (1, "Klinikum Nord\nAbteilung für Innere Medizin\n-----\nSehr geehrter Herr Meier, Ihre Patientin Frau Anna Schmidt, geb. 01.02.1960, wurde vom 03.04.2024 bis 05.04.2024 behandelt. Tel.: 0211 / 123456-78 Fax 0211 998877"),
    (2, "Neuss, 12.03.2024\nDr. med. Weber und Prof. Dr. Krause. Fallnummer: 1234567890, Status M, AOK Nr. A123456789. CT vom 01.01.2023, Kontrolle am 2. März 2023."),
    (3, "Name: Müller, Anna\nMusterstraße 12a, 41460 Neuss, IBAN DE89 3704 0044 0532 0130 00, HRB 12345, a.b@praxis-meier.de www.dr-huber.de"),
    (4, "J. Chahem sah Vitamin D. Mangel. Hämoglobin 13,5 g/dl (12-16). Zeichen: AB/2024/0815 * 3.4.1955"),
    (5, "Mr John Smith, dob 01/02/1960, SSN: 123-45-6789, phone: 555-123-4567, lives at 12 Main Street, 12345. Patient ID: AB-12345. March 5, 2024"),
    (6, "  "),
    (7, None),
]


def plain_removal(text, language):
    """The same passes with the re module: text, removals, dates kept, kinds."""
    import re

    from vellum.functions import privacy

    text, n, kept, kinds = text or "", 0, 0, []
    if len(text) >= 100 and any(re.search(h, text[:800].lower()) for h in privacy.HOSPITALS):
        end = next((m.start() for e in privacy.LETTERHEAD_ENDS if (m := re.search(e, text[:1000], re.I))), 0)
        if end and any(re.search(h, text[:end].lower()) for h in privacy.HOSPITALS):
            text = "[HOSPITAL_LETTERHEAD]\n" + text[end:].lstrip()
    for kind, ignore_case, expression in privacy.passes(language):
        found = list(re.finditer(expression, text, re.I if ignore_case else 0))
        if kind in privacy.DATED:
            out, gone, at = "", 0, 0
            for m in found:
                before = text[max(0, m.start() - 80) : m.start()].lower()
                hit = lambda xs, before=before: any(re.search(x, before) for x in xs)
                stays = not hit(privacy.BIRTH) and (hit(privacy.TREATMENT) or not (m.start() < 500 and hit(privacy.HEAD)))
                out, at, gone, kept = out + text[at : m.start()] + (m[0] if stays else "[DATE]"), m.end(), gone + (not stays), kept + stays
            text, count = out + text[at:], gone
        else:
            text, count = re.sub(expression, lambda m, kind=kind: privacy.placeholder(kind), text, flags=re.I if ignore_case else 0), len(found)
        n += count
        kinds += [kind] * (count > 0)
    from vellum.functions.redaction import CLEANUP

    for a, b in CLEANUP:
        text = re.sub(a, lambda m, b=b: b, text)
    return text, n, kept, ",".join(kinds)


@pytest.mark.parametrize("language", ["de", "en"])
def test_personal_data_passes(spark, sf, language):
    from vellum.functions import privacy

    rows = LETTERS + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = privacy.removed(spark.createDataFrame(rows, "id long, text string"), language).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.redacted, r.removals, r.dates_kept, r.kinds) == plain_removal(r.text, language)
        assert r.error == (not (r.text or "").strip(" "))
    if language == "de":
        assert got[0].redacted.startswith("[HOSPITAL_LETTERHEAD]\n") and "Schmidt" not in got[0].redacted and "03.04.2024" in got[0].redacted and "12.03.2024" not in got[1].redacted


def test_quick_passes_find_the_same(spark):
    """Letters that match without case, runs, matches side by side: gates and quick expressions change no match."""
    from vellum.functions import privacy

    odd = ["Patıent-id: ABCDE12", "PATİENT: X, Y", "Kran\u212aenkassennummer: A123456789", "Haupt\u017ftraße 12a", "Hauptstr. 5aHauptweg 3, 41460 Neuss", "éHauptstraße 5 ßß Ringß 5", "aßbweg 12, 12345 X", "A.Bc ABCDDEFF XABCDDEFFXX Müller,Anna, ,Status x, Bernd ,", "x, Bernd ,\n",
           "Dr. Weber Dr. med. Huber, Tel 0211 123456 Fon: 0211 998877 / 12 HERR Meier Frau  Abc-Def", "* 3.4.1955 geb.: 01.02.60 birth 01.02.60 BIC DEUTDEFF500 SPARKASSE Köln-Bonn ıng Köln", "Name: 1 [NAME] [NAME] 12345[PLZ_CITY] []"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*odd, " ".join(odd), *(t for _, t in LETTERS if t)])], "id long, text string")
    for language in ("de", "en"):
        for kind, ignore_case, text in privacy.passes(language):
            plain, quick = (privacy.pattern(ignore_case, x) for x in (text, privacy.quick(language, kind, ignore_case, text)))
            found = rows.select("text", F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(quick), F.lit(0)).alias("b"), privacy.may_match(kind, language, ignore_case, F.col("text"), privacy.folded(F.col("text")), F.col("text").rlike(r"\p{Nd}")).alias("may"))
            for r in found.collect():
                assert r.a == r.b and (r.may or not r.a), (kind, r)
    got = {r.id: r for r in privacy.removed(rows, "de").collect()}
    assert got[0].kinds == "patient_id" and "ABCDE12" not in got[0].redacted


def test_step_routing(spark):
    """A step's output replaces the text, is appended, is logged alone or is skipped; a stop ends the program."""
    from vellum.plans.steps import Program, Step, run

    program = Program([
        Step("gate", 1, "length_gate", stop_on=("NICHT_MEDIZINISCH",)), Step("up", 2, "upper"), Step("more", 3, "lower", append=True), Step("kind", 4, "class_by_length", branching=True, classes=("LANG", "KURZ")),
        Step("aside", 5, "length_gate", replaces=False), Step("long only", 6, "lower", document_class="LANG"), Step("needs", 7, "upper", requires=("x",)), Step("last", 1, "trim", post_branching=True),
    ])
    docs = spark.createDataFrame([(1, "Ein Text von mehr als vierzig Zeichen,  mit Luecken", None), (2, "kurz", "y"), (3, None, None)], "doc_id long, text string, x string")
    got = {r.doc_id: r for r in run(docs, program, context=("x",)).collect()}
    upper = "EIN TEXT VON MEHR ALS VIERZIG ZEICHEN,  MIT LUECKEN"
    assert got[1].output == f"{upper} {upper.lower()}".replace("  ", " ") and got[1].document_class == "KURZ" and got[1].status == "COMPLETED"
    assert [(x.step, x.status) for x in got[1].log] == [("gate", "COMPLETED"), ("up", "COMPLETED"), ("more", "COMPLETED"), ("kind", "COMPLETED"), ("aside", "COMPLETED"), ("needs", "SKIPPED"), ("last", "COMPLETED")]
    for i in (2, 3):
        assert got[i].status == "TERMINATED" and got[i].stopped_at == "gate" and len(got[i].log) == 1


def test_first_provider_ties_and_missing_parts(spark, tmp_path):
    """Equal ids count in the table's order, and a log without a part has the empty number's provider, as in SQL."""
    import duckdb

    from vellum.plans import relational

    n = 3000
    con = duckdb.connect()
    # every id many times; parts of odd keys are missing
    con.execute(f"CREATE TABLE lineitem AS SELECT CAST((i % 5) * 20 + 1 AS BIGINT) AS l_orderkey, CAST(1 AS INT) AS l_linenumber, CAST((i * 7919 + 13) % 40 AS BIGINT) AS l_partkey, 1.0::DOUBLE AS l_quantity, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1995-01-01' AS l_shipdate FROM range({n}) t(i) ORDER BY i")
    con.execute("CREATE TABLE part AS SELECT CAST(2 * i AS BIGINT) AS p_partkey, 'Brand#' || (i % 3) AS p_brand, CAST(i AS INT) AS p_size FROM range(20) t(i)")
    for t in ("lineitem", "part"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute("SET threads = 1")
    want = sorted(con.execute(relational.ORACLE_SQL["g2_first_provider"]).fetchall())
    got = sorted((r.model, r.provider) for r in relational.QUERIES["g2_first_provider"](spark, str(tmp_path)).collect())
    assert got == want and ("Unknown", "provider_") in got


def test_quick_contacts_find_the_same(spark):
    """The expressions in use match what the fixed ones match, beside and behind other matches too."""
    import random

    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "b.", "@", "@c.de", ".", "_x", "%", " ", "+49 30 12345", "-1", "ä", "10.0.0.1"]) for _ in range(rng.randrange(25))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate([*made, "a@b.c_d@e.f", "x@y.z.@q.r", "@a@b.c", "a" * 50_000, None])]
    df = spark.createDataFrame(rows, "id int, text string")
    plain, counts = F.coalesce("text", F.lit("")), {}
    for kind, pattern, placeholder in redaction.CONTACTS:
        counts[f"n_{kind}"], plain = F.regexp_count(plain, F.lit(pattern)), F.regexp_replace(plain, pattern, placeholder)
    small = df.where("length(text) < 1000 or text is null")
    want = {r.id: r for r in small.select("id", plain.alias("masked"), *[c.alias(n) for n, c in counts.items()]).collect()}
    for r in redaction.with_counts(df).select("*", redaction.masked(F.coalesce("text", F.lit(""))).alias("again")).collect():
        assert r.masked == r.again
        if r.id in want:
            assert (r.masked, *[r[n] for n in counts]) == (want[r.id].masked, *[want[r.id][n] for n in counts])


def test_lowered_once(spark):
    """A text is put in lower case once for all its terms."""
    from vellum.functions import privacy

    df = spark.createDataFrame([("Hämoglobin und Labor",), ("",), (None,)], "t string")
    for column in (documents.table_score(F.col("t")), privacy.preserved(F.col("t"), F.upper("t"))):
        assert df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count("lower(") <= 2
    assert [r.x for r in df.select(privacy.preserved(F.col("t"), F.lit("labor")).alias("x")).collect()] == [False, True, True]
