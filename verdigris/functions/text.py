"""Answer text as Column -> Column functions: normalisers, extraction, parsers, prompt builders, content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, markers, wrappers, stop sequences and prompt wordings that results depend on.
BASIC_NUMBERS = "zero one two three four five six seven eight nine ten".split()
NUMBERS = {w: str(i) for i, w in enumerate(BASIC_NUMBERS + "eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {w: str(10 * i) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), start=2)}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WRAPPERS = ("A", "CHAT", "ANSWER", "OUT", "RESP", "ANS")
STOP_MARKERS = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[QUESTION]", "[/QUESTION]")
STOP_SEQUENCES = ("\n\n\n\n", "\n\n\n", "\n\n", "\n", "Question:", "Context:")
BRIEFS = {
    "default": "Answer the following question as briefly as possible.\n",
    "chat": "Answer the following question in a single brief but complete sentence.\n",
}
PTRUE_BRIEF = "Answer the following question. Consider the brainstormed answers, then decide whether the proposed answer is correct."
ENTAILMENT_TEMPLATE = (
    'We are evaluating answers to the question "{question}"\nHere are two possible answers:\nPossible Answer 1: {first}\nPossible Answer 2: {second}\n'
    "Does Possible Answer 1 semantically entail Possible Answer 2? Respond with entailment, contradiction, or neutral."
)
GRADE_ONE = (
    "We are assessing the quality of answers to the following question: {question}\nThe expected answer is: {references}.\nThe proposed answer is: {proposed}\n"
    "Within the context of the question, does the proposed answer mean the same as the expected answer? Respond only with yes or no.\nResponse:"
)
GRADE_MANY = (
    "We are assessing the quality of answers to the following question: {question}\nThe following are expected answers to this question: {references}.\nThe proposed answer is: {proposed}\n"
    "Within the context of the question, does the proposed answer mean the same as any of the expected answers? Respond only with yes or no.\nResponse:"
)

#: White space as Python's str methods see it.
SPACE = r"[\s\x1c-\x1f]"
NUMBER = r"(?U)-?\d+(?:\.\d+)?"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: bound to a lambda's variable, it isn't expanded at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column, chars: str = SPACE) -> Column:
    return F.regexp_replace(c, rf"(?U)^{chars}+|{chars}+\z", "")


def lstrip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"(?U)^{chars}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"(?U){SPACE}+", " ")


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's value, or c itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)


def normalize_basic(c: Column) -> Column:
    """Strip, lower case, collapse white space; a whole string zero to ten becomes its digits."""
    return mapped(collapse(F.lower(c)), {w: NUMBERS[w] for w in BASIC_NUMBERS})


def normalize_freeform(c: Column) -> Column:
    """Strip, lower case, collapse white space, then strip .,;:!?\"' at both ends; spaces laid bare stay."""
    return F.regexp_replace(collapse(F.lower(c)), "^[.,;:!?\"']+|[.,;:!?\"']+\\z", "")


def normalize_qa(c: Column) -> Column:
    """Lower case, drop ASCII punctuation, blank out articles, collapse white space."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def normalize_numeric(c: Column) -> Column:
    """Number words, thousands separators, the part after the last = if it holds a number, then the first number.

    Whole values print without a fraction, others without superfluous zeros; without a number: stripped and lower case.
    """

    def of(s: Column) -> Column:
        low = F.lower(s)
        clean = F.regexp_replace(s, r"(?U)(?<=\d),(?=\d)", "")
        tail = F.substring_index(clean, "=", -1)
        found = F.regexp_extract(F.when(clean.contains("=") & tail.rlike(NUMBER), tail).otherwise(clean), NUMBER, 0)

        def printed(n: Column) -> Column:
            value = n.cast("double")
            whole = value.cast("decimal(38,0)").cast("string")
            short = F.regexp_replace(F.regexp_replace(n, r"^(-?)0+(?=\d)", "$1"), r"0+\z", "")
            return F.when(n == "", low).when(value == F.floor(value), whole).otherwise(short)

        words = mapped(low, NUMBERS)
        return F.when(words != low, words).otherwise(let(found, printed))

    return let(strip(c), of)


def normalize_for(dataset: Column, c: Column) -> Column:
    """The dataset's normaliser; others: lower case and collapsed white space."""
    return (
        F.when(dataset.isin("triviaqa", "nqopen"), normalize_qa(c)).when(dataset == "svamp", normalize_numeric(c)).when(dataset == "bio", normalize_freeform(c)).otherwise(collapse(F.lower(c)))
    )


def cut_at(c: Column, marks: tuple[str, ...]) -> Column:
    """Up to the earliest of marks."""
    places = [F.nullif(F.locate(m, c), F.lit(0)) for m in marks]
    return F.substring(c, F.lit(1), F.coalesce(F.least(*places) - 1, F.length(c)))


def truncate_at_stop(c: Column) -> Column:
    return cut_at(c, STOP_SEQUENCES)


def extract_answer(c: Column, single_line: bool = True) -> Column:
    """One sample without chat echo: unwrapped, cut at the first marker, first filled line, stray tags off."""
    raw = F.replace(F.replace(c, F.lit("<0x0A>"), F.lit("\n")), F.lit("<0x0D>"), F.lit(""))

    def unwrap(s: Column) -> Column:
        out: Column | None = None
        for name in WRAPPERS:
            op, cl = (f"<{name}>", f"</{name}>") if name == "A" else (f"[{name}]", f"[/{name}]")
            after = F.substring(s, F.locate(op, s) + len(op), F.length(s))
            inner = F.when(F.locate(cl, after) > 0, F.substring(after, F.lit(1), F.locate(cl, after) - 1)).otherwise(after)
            fits = s.contains(op) & s.contains(cl) & (strip(inner) != "")
            out = F.when(fits, inner) if out is None else out.when(fits, inner)
        return out.otherwise(s)

    def line(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: strip(x)), lambda x: x != "")
        return F.coalesce(F.get(lines, 0), strip(s))

    cut = let(let(raw, unwrap), lambda s: cut_at(s, STOP_MARKERS))
    kept = let(cut, line) if single_line else cut
    return strip(F.regexp_replace(F.regexp_replace(kept, "</?[A-Za-z]{1,10}>", ""), r"\[/?[A-Za-z][A-Za-z0-9]{0,11}\]", ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def token_f1(left: Column, right: Column) -> Column:
    """Multiset token F1 of two normalised strings: both empty 1, one empty 0."""

    def of(pair: Column) -> Column:
        p, r = pair["p"], pair["r"]
        shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(r, lambda x: x == t))))
        return F.when((F.size(p) == 0) | (F.size(r) == 0), ((F.size(p) == 0) & (F.size(r) == 0)).cast("double")).otherwise(2.0 * shared / (F.size(p) + F.size(r)))

    return let(F.struct(tokens(left).alias("p"), tokens(right).alias("r")), of)


def best_answer_correct(answer: Column, references: Column, dataset: Column) -> Column:
    """svamp: equal to some normalised reference; else the best token F1 is at least 0.5. No references: false."""
    best = F.coalesce(F.array_max(F.transform(references, lambda r: token_f1(normalize_qa(answer), normalize_qa(r)))), F.lit(0.0)) >= 0.5
    exact = F.exists(references, lambda r: normalize_numeric(r) == normalize_numeric(answer))
    return F.when(F.size(references) < 1, False).when(dataset == "svamp", exact).otherwise(best)


def any_match_correct(normalized: Column, references: Column, dataset: Column) -> Column:
    return F.arrays_overlap(normalized, F.transform(references, lambda r: normalize_for(dataset, r)))


def parse_yes_no(c: Column) -> Column:
    """entailment if the verdict begins with yes, else neutral."""
    return F.when(lstrip(F.lower(strip(c)), "[\"' .:,\\-*]").startswith("yes"), "entailment").otherwise("neutral")


def parse_verdict(c: Column, strict: bool = True) -> Column:
    """correct -> true, incorrect -> false; anything else is an error (strict) or null."""
    low = lstrip(F.lower(strip(c)), "[\"' .:,\\-*]")
    bad = F.raise_error(F.concat(F.lit("unrecognized correctness judgment: "), F.coalesce(c, F.lit("null")))).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(low.startswith("incorrect"), False).when(low.startswith("correct"), True).otherwise(bad)


def parse_confidence(c: Column) -> Column:
    """A number in [0, 1], else null."""
    number = F.when(strip(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), strip(c)).cast("double")
    return F.when((number >= 0) & (number <= 1), number)


def parse_yes_anywhere(c: Column) -> Column:
    """1 if yes occurs anywhere, else 0 if no does (also in know), else null."""
    return F.when(F.lower(c).contains("yes"), 1.0).when(F.lower(c).contains("no"), 0.0)


def canonical_label(c: Column) -> Column:
    """entailment or contradiction by substring (not entailed too), else neutral."""
    return F.when(F.lower(c).contains("entail"), "entailment").when(F.lower(c).contains("contradict"), "contradiction").otherwise("neutral")


def extract_entity(c: Column) -> Column:
    found = F.regexp_extract(c, rf"(?iUs)^(?:tell me a bio of|bio of){SPACE}+([^\n]+?)\.?{SPACE}*\z", 1)
    return F.when(found != "", strip(found)).otherwise(strip(c))


def resolve_question(question: Column, prompt: Column) -> Column:
    """The filled one of the two; different filled ones are an error."""
    q, p = F.nullif(strip(question), F.lit("")), F.nullif(strip(prompt), F.lit(""))
    return F.when(q != p, F.raise_error(F.lit("record has conflicting question and prompt fields")).cast("string")).otherwise(F.coalesce(q, p))


def ptrue_prompt(question: Column, answers: Column, proposed: Column, prefix: Column | None = None) -> Column:
    """The P(True) prompt of one record, behind a few-shot prefix where there is one."""
    lines = F.array_join(F.transform(F.concat(answers, F.array(proposed)), lambda a: strip(a)), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("Question: "), strip(question)), F.lit("Brainstormed Answers: "), lines, F.concat(F.lit("Possible answer: "), strip(proposed)), F.lit("Is the possible answer:"), F.lit("A) True"), F.lit("B) False"), F.lit("The possible answer is:"))
    return body if prefix is None else F.concat(F.when(F.coalesce(prefix, F.lit("")) == "", "").otherwise(F.concat(rstrip(prefix), F.lit("\n"))), body)


def ptrue_prefix(examples: Column) -> Column:
    """A few-shot prefix from labelled examples: array of struct(question, answers, proposed, correct)."""
    shown = F.transform(examples, lambda e: F.concat(ptrue_prompt(e["question"], e["answers"], e["proposed"]), F.when(e["correct"], " A").otherwise(" B"), F.lit("\n")))
    return rstrip(F.concat_ws("\n", F.lit(PTRUE_BRIEF), F.lit(""), F.array_join(shown, "\n")))


def completion_prompt(question: Column, demonstrations: Column | None = None, regime: str = "chat", context: Column | None = None) -> Column:
    """The regime's brief, demonstrations (array of struct question, answer), then the open query."""
    demos = F.lit("") if demonstrations is None else F.array_join(F.transform(demonstrations, lambda d: F.concat(F.lit("Question: "), strip(d["question"]), F.lit("\nAnswer: "), strip(d["answer"]), F.lit("\n\n"))), "")
    passage = F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(BRIEFS[regime]), demos, passage, F.lit("Question: "), question, F.lit("\nAnswer:"))


def filled(template: str, **values: Column) -> Column:
    """The template with its {names} replaced, none of them inside another's value."""
    parts: list[Column] = []
    rest = template
    while rest:
        names = [(rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest]
        if not names:
            parts.append(F.lit(rest))
            break
        at, name = min(names)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def entailment_prompt(question: Column, first: Column, second: Column) -> Column:
    return filled(ENTAILMENT_TEMPLATE, question=question, first=first, second=second)


def grading_prompt(question: Column, references: Column, proposed: Column) -> Column:
    """One reference in plain form, several as a bracketed list of quoted strings."""
    quoted = F.transform(references, lambda r: F.when(r.contains("'") & ~r.contains('"'), F.concat(F.lit('"'), r, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(F.replace(r, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))))
    many = filled(GRADE_MANY, question=question, references=F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), proposed=proposed)
    return F.when(F.size(references) == 1, filled(GRADE_ONE, question=question, references=F.get(references, 0), proposed=proposed)).otherwise(many)


def question_answer_input(question: Column, answer: Column, style: str = "labelled") -> Column:
    """What the entailment model reads; a blank question is an error."""
    asked = strip(question)
    q = F.when(F.coalesce(asked, F.lit("")) == "", F.raise_error(F.lit("a question is blank")).cast("string")).otherwise(asked)
    return F.concat(q, F.lit(" "), answer) if style == "paper" else F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), answer)


def content_key(*parts: Column) -> Column:
    """md5 over the parts, each followed by a NUL."""
    return F.md5(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]).cast("binary"))


def answer_of(c: Column) -> Column:
    """An answer that is a JSON string, or an object's response."""
    return F.coalesce(F.get_json_object(c, "$.response"), F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"])


def question_id(dataset: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws("\0", dataset, question), 256)


def claim_identity(claim_id: Column, proposition: Column) -> Column:
    """SHA-256 of both, stripped, as a JSON array: it binds a label to one exact claim; blank ones are an error."""
    parts = []
    for name, c in (("claim_id", claim_id), ("proposition", proposition)):
        text = strip(c.cast("string"))
        parts.append(F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit(f"{name} must not be empty")).cast("string")).otherwise(text))
    return F.sha2(F.to_json(F.array(*parts)), 256)


def hex_decimal(digits: Column, n: int) -> Column:
    """A number of n hexadecimal digits (at most 32) in decimal, by decimal(38) arithmetic on pieces of seven digits."""
    total = F.lit(0).cast("decimal(38,0)")
    for at in range(0, n, 7):
        size = min(7, n - at)
        piece = F.conv(F.substring(digits, at + 1, size), 16, 10).cast("decimal(10,0)")
        total = (total * F.lit(16**size).cast("decimal(10,0)") + piece).cast("decimal(38,0)")
    return total


def prompt_seed(seed: Column, prompt: Column) -> Column:
    """The first eight bytes of sha256(seed NUL prompt) modulo 2**63 - 1."""
    return (hex_decimal(F.sha2(F.concat_ws("\0", seed.cast("string"), prompt), 256), 16) % F.lit(2**63 - 1).cast("decimal(19,0)")).cast("long")


def is_revision(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{40}$"), F.lit(False))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def ptrue_uncertainty(p: Column) -> Column:
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def length_normalized(logprob: Column, n_tokens: Column) -> Column:
    """logprob per token; without tokens the logprob itself."""
    return F.coalesce(F.try_divide(logprob, n_tokens), logprob)
