"""Sources, projections and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import lifecycle
from verdigris.plans import base as B
from verdigris.plans.catalogue import query

c = F.col


@query("""SELECT p_partkey AS source_index, 'part-' || p_partkey AS prompt_id, p_name || ' ' || p_type AS prompt, [CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END] AS reference_answers FROM part""")
def prompts_from_parts(s, d):
    price = c("p_retailprice")
    answer = F.when(price == F.floor(price), price.cast("long").cast("string")).otherwise(price.cast("string"))
    return B.table(s, d, "part").select(c("p_partkey").alias("source_index"), F.concat(F.lit("part-"), c("p_partkey")).alias("prompt_id"), F.concat_ws(" ", "p_name", "p_type").alias("prompt"), F.array(answer).alias("reference_answers"))


def aliases():
    return F.filter(F.array(F.nullif(c("c_mktsegment"), F.lit("BUILDING")), F.lit(""), F.when(c("c_acctbal") > 0, c("c_name"))), lambda x: x.isNotNull() & (x != ""))

SQL_ALIASES = "list_filter([nullif(c_mktsegment, 'BUILDING'), '', CASE WHEN c_acctbal > 0 THEN c_name END], lambda x: x IS NOT NULL AND x <> '')"


@query(f"SELECT c_custkey, CASE WHEN len({SQL_ALIASES}) > 0 THEN {SQL_ALIASES} ELSE [c_name] END AS refs FROM customer")
def reference_fallback(s, d):
    return B.table(s, d, "customer").select("c_custkey", F.when(F.size(aliases()) > 0, aliases()).otherwise(F.array("c_name")).alias("refs"))


@query(f"SELECT c_custkey FROM customer WHERE len(list_filter({SQL_ALIASES}, lambda x: trim(x) <> '')) > 0")
def answerable_filter(s, d):
    return B.table(s, d, "customer").where(F.exists(aliases(), lambda x: F.trim(x) != "")).select("c_custkey")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 200 AND 2000")
def length_band_filter(s, d):
    return B.table(s, d, "documents").where(F.length("text").between(200, 2000)).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN text ELSE '' END, ''), role) AS question FROM conversations")
def candidate_projection(s, d):
    return B.table(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.nullif(F.when(c("turn") % 2 == 0, c("text")).otherwise(""), F.lit("")), "role").alias("question"))


def _on_samples(f):
    return lambda s, d: B.samples(s, d).select("user_id", "rec", "i", f(c("raw")).alias("out"))


def each(out: str) -> str:
    return f"WITH {B.SAMPLES} SELECT user_id, rec, i, {out} AS out FROM samples"


query(each("trim(regexp_replace(lower(raw), '\\s+', ' ', 'g'))"), "normalize_basic")(_on_samples(T.normalize_basic))
query(each("regexp_replace(trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')), '^[.,;:!?\"'']+|[.,;:!?\"'']+$', '', 'g')"), "normalize_freeform")(_on_samples(T.normalize_freeform))
query(each("norm"), "normalize_qa")(_on_samples(T.normalize_qa))

def numeric_input():
    return F.when(c("k") % 5 == 0, F.concat(F.lit(" "), c("k"), F.lit(",000 apples"))).when(c("k") % 5 == 1, F.concat(F.lit("3 + 5 = "), c("k"), F.lit(".50"))).when(c("k") % 5 == 2, F.lit(" Seven ")).when(c("k") % 5 == 3, F.concat(F.lit("-"), c("k"), F.lit(".0 left = none"))).otherwise(F.lit(" No Number "))


@query(f"""WITH {B.SAMPLES} SELECT user_id, rec, i, CASE k % 5 WHEN 0 THEN CAST(k * 1000 AS VARCHAR) WHEN 1 THEN k || '.5' WHEN 2 THEN '7' WHEN 3 THEN CAST(-k AS VARCHAR) ELSE 'no number' END AS out FROM samples""")
def normalize_numeric(s, d):
    return B.samples(s, d).select("user_id", "rec", "i", T.normalize_numeric(numeric_input()).alias("out"))


@query(f"WITH {B.SAMPLES} SELECT user_id, rec, i, CASE user_id % 4 WHEN 0 THEN norm WHEN 1 THEN regexp_replace(trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')), '^[.,;:!?\"'']+|[.,;:!?\"'']+$', '', 'g') WHEN 2 THEN lower(trim(raw)) ELSE trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) END AS out FROM samples")
def normalize_dispatch(s, d):
    name = F.element_at(F.array(*map(F.lit, ("nqopen", "bio", "svamp", "other"))), (c("user_id") % 4 + 1).cast("int"))
    return B.samples(s, d).select("user_id", "rec", "i", T.normalize_for(name, c("raw")).alias("out"))


@query(each(r"trim(CASE i % 5 WHEN 0 THEN raw WHEN 1 THEN raw WHEN 2 THEN raw WHEN 3 THEN raw ELSE '' END)"))
def extract_answer(s, d):
    raw = c("raw")
    shown = F.element_at(F.array(F.concat(F.lit("x [ANS]"), raw, F.lit("[/ANS] y")), F.concat(F.lit("\n "), raw, F.lit("\n<s>[INST] next")), F.concat(F.lit("<A><0x0A>"), raw, F.lit("</A>")), F.concat(F.lit("[OUT] "), raw, F.lit("</s> tail [/OUT]")), F.lit("[ANSWER][/ANSWER]")), (c("i") % 5 + 1).cast("int"))
    return B.samples(s, d).select("user_id", "rec", "i", T.extract_answer(shown).alias("out"))


@query(each(r"CASE i % 3 WHEN 0 THEN raw WHEN 1 THEN raw || ' ' ELSE '' END"))
def truncate_stop(s, d):
    shown = F.when(c("i") % 3 == 0, F.concat("raw", F.lit("\n\nmore"))).when(c("i") % 3 == 1, F.concat("raw", F.lit(" Question: next\nContext: z"))).otherwise(F.concat(F.lit("Context: "), c("raw")))
    return B.samples(s, d).select("user_id", "rec", "i", T.truncate_at_stop(shown).alias("out"))


# Unicode white space and word characters spelled out: DuckDB's \s and \b know ASCII only.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_words(x: str) -> str:
    """The words of a whole text, normalised as T.normalize_qa does; neighbouring articles share a boundary, so twice."""
    bare = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    for _ in range(2):
        bare = f"regexp_replace({bare}, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}])(a|an|the)($|[^\\p{{L}}\\p{{N}}\\p{{M}}])', '\\1 \\3', 'g')"
    return f"list_filter(string_split_regex({bare}, '{WHITE}'), lambda w: w <> '')"


TURNS = f"pairs AS (SELECT a.conv_id, a.turn, {sql_words('a.text')} AS p, {sql_words('b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
F1 = f"""{TURNS},
f1 AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 OR len(r) = 0 THEN CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 ELSE 0.0 END
  ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda x: x = t))))), 0) / (len(p) + len(r)) END AS f FROM pairs)"""


def _turns(s, d):
    t = B.table(s, d, "conversations")
    b = t.select("conv_id", (c("turn") - 1).alias("turn"), c("text").alias("r"))
    return t.select("conv_id", "turn", c("text").alias("p")).join(b, ["conv_id", "turn"])


@query(f"WITH {F1} SELECT conv_id, turn, round(f, 6) AS f1 FROM f1")
def token_f1(s, d):
    return _turns(s, d).select("conv_id", "turn", F.round(T.token_f1(T.normalize_qa(c("p")), T.normalize_qa(c("r"))), 6).alias("f1"))


@query(f"WITH {F1} SELECT conv_id, turn, f >= 0.5 AS correct FROM f1")
def best_answer_correct(s, d):
    return _turns(s, d).select("conv_id", "turn", T.best_answer_correct(c("p"), F.array("r", F.lit("")), F.lit("triviaqa")).alias("correct"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, list_contains(norm, 'click') OR list_contains(norm, 'signup') AS correct FROM records")
def any_match_correct(s, d):
    return B.records(s, d).select("user_id", "rec", T.any_match_correct(c("norm"), F.array(F.lit("The Click!"), F.lit("signup")), F.lit("triviaqa")).alias("correct"))


@query(f"WITH {B.RECORDS}, best AS (SELECT *, (SELECT raw[min(j)] FROM (SELECT j, len(list_filter(raw, lambda x: x = raw[j])) AS n FROM (SELECT unnest(range(1, len(raw) + 1)) AS j) QUALIFY n = max(n) OVER ())) AS m FROM records), told AS (SELECT user_id, rec, CASE rec % 3 WHEN 0 THEN 'A click!' WHEN 1 THEN raw[1] ELSE m END AS best FROM best) SELECT user_id, rec, best, trim({B.sql_norm('best')}) = 'click' AS correct FROM told")
def paper_correct(s, d):
    """Of a record's greedy answer, its recorded most likely one and its commonest sample the first there is is graded."""
    r = B.records(s, d).select("user_id", "rec", c("raw").alias("sampled_answers"), F.array(F.lit("click")).alias("reference_answers"), F.lit("nqopen").alias("dataset"), F.when(c("rec") % 3 == 0, "A click!").alias("sep_greedy_answer"), F.when(c("rec") % 3 < 2, F.get("raw", 0)).alias("most_likely_answer"))
    return lifecycle.graded(r, paper=True).select("user_id", "rec", c("most_likely_answer").alias("best"), c("correctness_label").alias("correct"))


VERDICTS = ("Yes.", ' "yes, it does', "- no", "I know", "**YES**", "Maybe")

def _cases(*values: str) -> str:
    return f"WITH {B.SAMPLES} SELECT user_id, rec, i, CASE k % {len(values)} " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END AS out FROM samples"


def _picked(values: tuple, f):
    item = lambda: F.element_at(F.array(*map(F.lit, values)), (c("k") % len(values) + 1).cast("int"))
    return lambda s, d: B.samples(s, d).select("user_id", "rec", "i", f(item()).alias("out"))


query(_cases("'entailment'", "'entailment'", "'neutral'", "'neutral'", "'entailment'", "'neutral'"), "parse_yes_no")(_picked(VERDICTS, T.parse_yes_no))
query(_cases("1.0", "1.0", "0.0", "0.0", "1.0", "NULL"), "parse_yes_anywhere")(_picked(VERDICTS, T.parse_yes_anywhere))
query(_cases("true", "false", "true", "false"), "parse_verdict")(_picked(("CORRECT", " 'Incorrect.", "- correct!", "incorrect"), T.parse_verdict))
query(_cases("0.5", "NULL", "1.0", "NULL", "0.01", "NULL"), "parse_confidence")(_picked((" 0.5\n", "1.2", "1", "high", "1e-2", "nan"), T.parse_confidence))
query(_cases("'entailment'", "'entailment'", "'contradiction'", "'neutral'"), "canonical_label")(_picked(("ENTAILMENT", "not entailed", "contradictory", "other"), T.canonical_label))
query(_cases("'Marie Curie'", "'Ada'", "'Who was Ada?'", "'x. y'"), "extract_entity")(_picked(("Tell me a bio of Marie Curie.", "BIO OF  Ada . ", " Who was Ada? ", "tell me a bio of x. y"), T.extract_entity))
query(_cases("true", "false", "false"), "revision_check")(_picked(("0123456789abcdefABCDEF0123456789abcdef01", "xyz", "0123"), T.is_revision))
query(_cases("'q'", "'p'", "'same'"), "resolve_question")(lambda s, d: B.samples(s, d).select("user_id", "rec", "i", T.resolve_question(F.element_at(F.array(F.lit(" q "), F.lit(""), F.lit("same")), (c("k") % 3 + 1).cast("int")), F.element_at(F.array(F.lit(" "), F.lit("p"), F.lit(" same")), (c("k") % 3 + 1).cast("int"))).alias("out")))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, md5('Question: q' || user_id || chr(10) || 'Brainstormed Answers: ' || chr(10) || array_to_string(list_transform(raw, lambda x: trim(x)), chr(10)) || chr(10) || trim(raw[1]) || chr(10) || 'Possible answer: ' || trim(raw[1]) || chr(10) || 'Is the possible answer:' || chr(10) || 'A) True' || chr(10) || 'B) False' || chr(10) || 'The possible answer is:') AS prompt FROM records")
def build_ptrue_prompt(s, d):
    return B.records(s, d).select("user_id", "rec", F.md5(T.ptrue_prompt(F.concat(F.lit(" q"), c("user_id")), c("raw"), F.get("raw", 0))).alias("prompt"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, 'Answer the following question as briefly as possible.' || chr(10) || 'Question: a' || chr(10) || 'Answer: b' || chr(10) || chr(10) || 'Question: ' || raw[1] || chr(10) || 'Answer:' AS prompt FROM records")
def build_fewshot_prompt(s, d):
    return B.records(s, d).select("user_id", "rec", T.completion_prompt(F.get("raw", 0), F.array(F.struct(F.lit(" a ").alias("question"), F.lit("b").alias("answer"))), "default").alias("prompt"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, 'We are evaluating answers to the question \"q\"' || chr(10) || 'Here are two possible answers:' || chr(10) || 'Possible Answer 1: ' || raw[1] || chr(10) || 'Possible Answer 2: ' || raw[2] || chr(10) || 'Does Possible Answer 1 semantically entail Possible Answer 2? Respond with entailment, contradiction, or neutral.' AS prompt FROM records")
def build_entailment_prompt(s, d):
    return B.records(s, d).select("user_id", "rec", T.entailment_prompt(F.lit("q"), F.get("raw", 0), F.get("raw", 1)).alias("prompt"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, 'We are assessing the quality of answers to the following question: q' || chr(10) || CASE WHEN user_id % 2 = 0 THEN 'The expected answer is: ' || norm[1] || '.' ELSE 'The following are expected answers to this question: [''' || norm[1] || ''', \"it''s\"].' END || chr(10) || 'The proposed answer is: ' || raw[2] || chr(10) || 'Within the context of the question, does the proposed answer mean the same as ' || CASE WHEN user_id % 2 = 0 THEN 'the expected answer' ELSE 'any of the expected answers' END || '? Respond only with yes or no.' || chr(10) || 'Response:' AS prompt FROM records")
def build_grading_prompt(s, d):
    refs = F.when(c("user_id") % 2 == 0, F.array(F.get("norm", 0))).otherwise(F.array(F.get("norm", 0), F.lit("it's")))
    return B.records(s, d).select("user_id", "rec", T.grading_prompt(F.lit("q"), refs, F.get("raw", 1)).alias("prompt"))


@query(f"WITH {B.RECORDS} SELECT user_id, rec, 'q ' || raw[1] AS paper, 'Question: q' || chr(10) || 'Answer: ' || raw[1] AS labelled FROM records")
def question_answer_inputs(s, d):
    q = F.lit(" q\n")
    return B.records(s, d).select("user_id", "rec", T.question_answer_input(q, F.get("raw", 0), "paper").alias("paper"), T.question_answer_input(q, F.get("raw", 0)).alias("labelled"))


@query(f"WITH {B.SAMPLES} SELECT user_id, rec, i, md5('m' || chr(0) || 'strict' || chr(0) || raw || chr(0) || norm || chr(0)) AS key FROM samples")
def content_key_md5(s, d):
    return B.samples(s, d).select("user_id", "rec", "i", T.content_key(F.lit("m"), F.lit("strict"), c("raw"), c("norm")).alias("key"))


@query(f"WITH {B.SAMPLES} SELECT user_id, rec, i, sha256('nqopen' || chr(0) || raw) AS qid FROM samples")
def qid_sha256(s, d):
    return B.samples(s, d).select("user_id", "rec", "i", T.question_id(F.lit("nqopen"), c("raw")).alias("qid"))


@query(f"WITH {B.SAMPLES} SELECT user_id, rec, i, CAST(CAST('0x' || left(sha256(i || chr(0) || raw), 16) AS UBIGINT)::HUGEINT % 9223372036854775807 AS BIGINT) AS seed FROM samples")
def prompt_seed(s, d):
    return B.samples(s, d).select("user_id", "rec", "i", T.prompt_seed(c("i"), c("raw")).alias("seed"))


@query(f"WITH {B.SAMPLES} SELECT user_id, rec, i, CAST(CAST('0x' || md5(raw) AS UHUGEINT) AS VARCHAR) AS id FROM samples")
def question_md5_decimal(s, d):
    # 2**128 has 39 digits: two halves of decimal(38), then joined by their decimal digits.
    high, low = T.hex_decimal(F.substring(F.md5("raw"), 1, 16), 16), T.hex_decimal(F.substring(F.md5("raw"), 17, 16), 16)
    base, big = F.lit(10**13).cast("decimal(14,0)"), F.lit(2**64 // 10**13).cast("decimal(8,0)")
    # high * 2**64 + low = (high * big) * 10**13 + high * rest + low
    rest = F.lit(2**64 % 10**13).cast("decimal(14,0)")
    tail = (high * rest + low).cast("decimal(38,0)")
    head = (high * big + F.floor(tail / base)).cast("decimal(38,0)")
    digits = F.concat(head.cast("string"), F.lpad((tail % base).cast("decimal(13,0)").cast("string"), 13, "0"))
    return B.samples(s, d).select("user_id", "rec", "i", F.regexp_replace(digits, "^0+(?=.)", "").alias("id"))


@query(f"WITH {B.SAMPLES} SELECT user_id, rec, i, round(1 - greatest(0, least(1, k / 80.0)), 6) AS u, round(CASE WHEN k % 3 = 0 THEN lp ELSE lp / (k % 3) END, 6) AS lp_norm FROM samples")
def ptrue_uncertainty(s, d):
    return B.samples(s, d).select("user_id", "rec", "i", F.round(T.ptrue_uncertainty(c("k") / 80.0), 6).alias("u"), F.round(T.length_normalized(c("lp"), c("k") % 3), 6).alias("lp_norm"))
