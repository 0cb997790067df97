"""Template residue and error-page text (problem 9).

Method: each document is stripped of page navigation, titles and footers, and
the message that is left is normalised: numbers, addresses and dates are
masked. Equal normalised messages are grouped by hash across documents and
sources, and each group is classified once, by phrase and placeholder rules
that know how widely it recurs. A message of which every sentence is of a known
kind counts however rare it is; one that is known only in part, or only by a
word of such pages, counts when it recurs, word for word, in several sources;
one that no rule knows, in whatever language, when it holds no sign of content
and recurs in a share of all documents and sources. Texts with a sentence of
content have no message and are never grouped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_code, spread

#: A message known in part counts from so many documents and sources on.
RECURRING_DOCS = 5
RECURRING_SOURCES = 3
#: An unknown message counts from such a share of all documents and of all sources on, and
#: from the numbers above: a share does not fall as the corpus grows, as a number does.
SHARE_DOCS = 1e-4
SHARE_SOURCES = 0.01
#: Words (or Chinese characters) that an unknown message has at least; fewer say nothing.
UNKNOWN_WORDS = 5

_NAME = r"[A-Za-z][\w.-]*(?:[ \xa0][\w.-]+){0,4}"
# Forms of placeholders that a template leaves unfilled.
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|\[(?:Insert|Enter|Your|Add)\s{_NAME}(?:\shere)?\]|@@{_NAME}@@|(?<!\w)__{_NAME}__(?!\w)"
    rf"|(?<![\w%])%[A-Za-z][\w.-]*(?:[ \xa0][\w.-]+){{0,3}}%(?!\w)|\$\{{{_NAME}\}}|#\{{{_NAME}\}}|\[\[{_NAME}\]\]|<(?:enter|insert|your)\s{_NAME}>|«{_NAME}»|\[object Object\]",
    re.I,
)
#: Words of sentences that may speak of placeholders instead of leaving one; what the placeholder does there decides.
_MENTION = re.compile(r"\b(?:macros?|braces|brackets|exports?|exported|environment|variables?|syntax|notation|literal(?:ly)?|escaped?|expands?|substitut\w+)\b", re.I)
_CODE_LINE = re.compile(r"^(?: {4,}|\t)\S|[;{}]\s*$|^\s*(?:def|class|import|from|return|if|for|while|echo|export|set|var|let|const|print)\b.*[(=:$]")
_QUOTE = "[`\"'“”„‘’«»]"
_ARTICLES = r"(?:(?:the|an?|each|every|any|all|environment|literal|variables?|macros?|placeholders?|string|text|token|marker)\s+)*"
#: Before the placeholder: it is the object of such a verb or named by such a noun.
_SPOKEN_OF = re.compile(
    rf"\b(?:(?:export(?:s|ed|ing)?|expand(?:s|ed|ing)?|escap(?:es?|ed|ing)|substitut(?:es?|ed|ing))\s+{_ARTICLES}"
    rf"|(?:macros?|variables?|syntax|notation|literal(?:ly)?|placeholders?)\s+(?:(?:is|are|of|like|called|named|such as)\s+)?"
    rf"|(?:braces|brackets)\s+(?:around|of|in)\s+{_ARTICLES}){_QUOTE}?$",
    re.I,
)
_REPLACING, _REPLACED = re.compile(rf"\b(?:macros?|scripts?|templates?|engine|generator|tools?|parser|shell)\b.*\breplac(?:es?|ed|ing)\s+{_ARTICLES}{_QUOTE}?$", re.I), re.compile(rf"^{_QUOTE}?\s+(?:by|with)\b", re.I)
_HAPPENS = re.compile(rf"^{_QUOTE}?\s+(?:(?:is|are|was|were|gets?|(?:must|shall|will|has to) be|has been|stays?)\s+(?:not\s+|\w+ly\s+)?(?:expanded|escaped|exported|substituted|replaced|literal)|expands?|macros?|variables?|syntax|notation)\b", re.I)
#: Code on a line of its own, and what is code only next to another such line.
_SURELY_CODE = re.compile(r"^\s*(?:(?:export|set|var|let|const)\s+\w+\s*=|(?:def|class)\s+\w+.*[:({]\s*$|(?:echo|print)\b\s*\(?[\"'$]|(?:if|for|while)\s*[(\[]|from\s+\S+\s+import\b)")
_MAYBE_CODE = re.compile(r"^(?!\s*(?:[-*+•]|\d+[.)])\s)(?:.*[{}]\s*$|.*[=()\[\]<>].*;\s*$|\s*[\w.\[\]]+\s*[-+*/]?=\s*\S*[(\[\"']|\s*(?:def|class|import|from|return|if|for|while|echo|export|set|var|let|const|print)\b.*(?:[(=$]|:\s*$)|\s*(?:return|import)\b)")

# What pages carry around their content.
_NAVIGATION = re.compile(
    r"^(?:skip to (?:main )?content|menu|back to top|top|print|share|home|search|help|news|login|log in|sign in|archive|downloads|meetings|site map|sitemap|contact|imprint|privacy|about|next|previous"
    r"|you are here:.*|\[print\].*|\(c\) .*|© .*|copyright .*|all rights reserved\.?|ref\. ?\w+|request id \w+|privacy \| .*)$",
    re.I,
)
_STATUS = r"(?:not found|forbidden|service unavailable|internal server error|bad gateway|gateway time-?out|unauthori[sz]ed|bad request|gone|method not allowed|too many requests|request timeout)"
_THING = r"(?:document|entry|page|resource|file|site|item|content|link|article|address|url|service|server|view|topic|record|image|video|request|application|portal|section)"
_WHICH = r"(?:\w+ ){1,3}(?:you (?:are looking for|requested|asked for|are trying to \w+)|(?:behind|under|at) this (?:link|address|url)|(?:with|under) (?:the )?number #)"
_GONE = r"(?:does not exist|doesn't exist|no longer exists|(?:has been|was) (?:removed|deleted|moved)|(?:is|was) (?:temporarily |currently |no longer )?(?:unavailable|not available|not accessible|not found|available|gone)|(?:could not|cannot|can't) be (?:found|delivered|loaded|shown|reached|opened)|failed to (?:open|load))"
_SCRIPTS = r"(?:javascript|js|scripts?|(?:active )?scripting|script execution|a browser that runs scripts)"
_ERRORS = [
    rf"^(?:error )?#+ {_STATUS}\b.{{0,40}}$",
    rf"^(?:error|http|code|status|reason)\s?[: ]\s?(?:error )?(?:#+)?\s*\(?{_STATUS}?\)?[.!]?$",
    r"^error #+.{0,60}$",
    r"^(?:http|status|error code)\s?(?:error |status )?#+ [a-z' ]{2,40}$",
    r"^(?:page|pagina|página|seite|strona|side|sida) (?:non trovata|no encontrada|não encontrada|nicht gefunden|introuvable|niet gevonden|nie znaleziona|hittades inte)\b.{0,40}$",
    r"^page introuvable\b.{0,40}$",
    rf"^{_STATUS}[.!]?$",
    r"^(?:something went wrong|request failed|service error|oops|page not found|access (?:is )?denied|server error|application error|(?:an|the) (?:unexpected|internal|unknown) error (?:has )?occurred)\b.{0,50}$",
    rf"^(?:sorry|oops|we apologi[sz]e|unfortunately)?[,.:!]?\s*(?:the|this|that|your)\s(?:requested\s)?(?:{_THING}\b.{{0,90}}|{_WHICH}\b.{{0,60}}) ?\b{_GONE}\b.{{0,60}}$",
    r"^your session (?:has|is|was) (?:expired|timed out|ended)\b.{0,60}$",
    r"^you (?:do not have|don't have|lack) permission\b.{0,80}$",
    r"^you (?:are not allowed|have been blocked|have been logged out)\b.{0,80}$",
    r"^too many requests\b.{0,60}$",
    rf"^(?:we are|(?:the|this|our) {_THING} is) (?:down|closed|offline|under)\b.{{0,30}}\bmaintenance\b.{{0,60}}$",
    r"^traceback \(most recent call last\):?$",
    r'^file "[^"]*", line #+',
    r"^raise \w+",
    r"^(?:caused by: )?[\w.$-]*(?:error|exception)(?:: |$)",
    r"^at [\w.$<>-]+\([\w.$ -]*(?::#+)?\)$",
    r"^(?:fatal error|parse error|warning|notice|uncaught \w+): .{3,160}$",
    r"^erreur #+ ?:.{0,120}$",
    r"^la page demandée\b.{0,40}\b(?:introuvable|indisponible)\b.{0,60}$",
    r"^die angeforderte seite\b.{0,40}\bnicht\b.{0,60}$",
    r"^(?:fehler #+|es ist ein fehler aufgetreten).{0,60}$",
    r"^se ha producido un error\b.{0,60}$",
    r"^la página solicitada\b.{0,60}$",
    r"^错误 ?#*.{0,40}$",
    r"^.{0,8}(?:页面|网页)(?:不存在|无法访问|已被删除).{0,20}$",
]
_NOTICES = [
    rf"^(?:please |you (?:need|have) to |you must )?(?:enable|activate|turn on|switch on|allow) (?:{_SCRIPTS}|cookies)\b.{{0,80}}$",
    rf"^(?:this|our|the|your) (?:\w+ ){{1,2}}(?:requires?|needs?|works? only with|depends? on|relies on|cannot be (?:shown|displayed|used) without|does not work without)\s{_SCRIPTS}\b.{{0,60}}$",
    rf"^(?:this|our|the|your) (?:\w+ ){{1,3}}could not (?:start|load|run) because {_SCRIPTS} (?:is|are)\b.{{0,60}}$",
    rf"^{_SCRIPTS} (?:is|are|seems? to be|must be|and cookies must be)\b.{{0,60}}$",
    rf"^your browser (?:has (?:them|{_SCRIPTS})|does not (?:run|support) {_SCRIPTS})\b.{{0,60}}$",
    r"^checking your browser\b.{0,60}$",
    rf"^(?:we're|we are) sorry,? but (?:\S+ ){{1,4}}(?:does not|doesn't) work (?:properly |correctly )?without {_SCRIPTS}\b.{{0,40}}$",
    rf"^(?:for (?:the )?(?:full|best) (?:functionality|experience) (?:of|on) (?:this|our|the) \w+,? )(?:it is necessary to |please |you (?:need|have) to |you must )?(?:enable|activate|turn on|switch on|allow) {_SCRIPTS}\b.{{0,60}}$",
    r"^bitte (?:aktivieren|schalten) sie javascript\b.{0,60}$",
    r"^veuillez activer javascript\b.{0,60}$",
    r"^(?:est[ea] \w+ (?:necesita|requiere)|active|habilite|por favor,? active) javascript\b.{0,60}$",
    r"^请(?:启用|开启|打开) ?javascript.{0,30}$",
]
_FILLERS = [
    r"^this is (?:a )?(?:sample|dummy|placeholder|example|filler) text\b.{0,30}$",
    r"^replace (?:it|this(?: text)?) with your own\b.{0,40}$",
    r"^coming soon\b.{0,30}$",
    r"^(?:(?:this|the|our) (?:page|site|website|section) is )?(?:currently )?under construction\b.{0,30}$",
    r"^(?:content|text|details)(?: for this \w+)? (?:will be added|to be added|goes here|to follow)\b.{0,20}$",
    r"^text text\b.{0,30}$",
    r"^more text goes here$",
    r"^add your \S+(?: \S+)? here$",
    r"^body copy follows\b.{0,20}$",
    r"^dies ist ein (?:blind|beispiel|muster)text\b.{0,30}$",
    r"^er steht hier nur\b.{0,60}$",
    r"^ceci est un texte d'exemple\b.{0,30}$",
    r"^(?:este|esto) es un texto de (?:ejemplo|muestra|relleno|prueba)\b.{0,40}$",
    r"^.{0,4}(?:此处|这里|这)(?:为|是).{0,3}(?:占位|示例|样例)文(?:字|本).{0,30}$",
]
_STRONG = re.compile("|".join(f"(?:{p})" for p in [*_ERRORS, *_NOTICES, *_FILLERS]))
#: What stands next to such messages, but alone says nothing.
_NEXT_TO = re.compile(
    r"^(?:please )?(?:try|check|contact|return|go back|reload|sign in|log in|thank you|loading|change your|switch it on|turn (?:it|them) on|if you think|that is all|no healthy|upstream|the operation timed out"
    r"|it (?:seems|may have|might have|could be)|use the|you (?:may|can) |we (?:are working|will be|apologi)|your (?:browser|address)|an add-on|this takes|code:|request id|ref\.|bitte|veuillez|actívelo|vuelva|请)\b|^请"
)
#: Words by which a sentence is known as content, not as part of a page's message.
_CONTENT = re.compile(r"\b(?:shall|should|may|might|can|could|able to|required to|expected to|need not|whenever|upon|unless|answers?|asks|logs)\b|[，。].*应|\b(?:gemäß|ohne|nach ablauf|selon|en cas|según|tras)\b")
#: A sentence that states what happens when is content, whatever phrase it holds.
_STATES = re.compile(r"\b(?:shall|should|whenever|unless|(?:when|if|that|because) (?:the|an?|no|it|its)|returns|answers|responds)\b(?!.*\b(?:you|your)\b)")
#: Words of such pages: known only by one, a message must recur.
_HINT = re.compile(
    r"\b(?:error|erreur|fehler|errore|erro|błąd|http|javascript|java script|cookies?|browser|navigateur|navegador|captcha|robot|log ?in|sign in|session|sitzung|sesión"
    r"|unavailable|not available|expired|maintenance|wartung|mantenimiento|under construction|loading|redirect(?:ed|ing)?|forbidden|denied|not found|introuvable|try again|subscribe)\b|错误|页面"
)
#: Such a message has at most so many words.
_HINT_WORDS = 40
#: Further signs of content in a sentence of no known kind: open points, paths and code with braces.
_OPEN = re.compile(r"\b(?:further study|ffs|tbd|to be (?:defined|determined|decided|confirmed)|editor'?s note)\b|[{}]|::=|\blorem ipsum\b")
# Words of filler texts.
_LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
_MASH = set("asdf qwer qwerty asdfg asdfgh hjkl yxcv zxcv foo bar baz bla blah xxx yyy zzz test tests testing dummy abc lorem".split())
_WORD = re.compile(r"[^\W\d_]+")
_UNIT = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_LINE_END, _SPACES, _HAS_WORD = re.compile(r"\r\n|\r|\n"), re.compile(r"\s+"), re.compile(r"\w")
_SEPARATED, _BULLET = re.compile(r" [|·>»›] "), re.compile(r"[*•-] \S")
_MASK = [
    (re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+|(?<!\w)/[\w./{}-]{3,}"), "@"),
    (re.compile(r"\b\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\b"), "#"),
    (re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b"), "#"),
    (re.compile(r"\d+"), "#"),
]


def masked(text: str) -> str:
    """Lower case, one blank between words, numbers, addresses and dates masked."""
    out = _SPACES.sub(" ", text).strip().lower()
    for r, to in _MASK:
        out = r.sub(to, out)
    return out


def _mentioned(sentence: str) -> bool:
    """Whether a placeholder of the sentence is what it speaks of: object of replace, export, expand ..., named or quoted."""
    if not _MENTION.search(sentence):
        return False
    for m in PLACEHOLDER.finditer(sentence):
        before, after = sentence[: m.start()], sentence[m.end() :]
        quoted = re.search(rf"{_QUOTE}$", before) and re.match(_QUOTE, after) and not re.search(rf":\s*{_QUOTE}$", before)
        if quoted or _SPOKEN_OF.search(before) or _HAPPENS.match(after) or (_REPLACING.search(before) and _REPLACED.match(after)):
            return True
    return False


def _in_code(lines: list[str], k: int) -> bool:
    """Whether line k is code by itself, or looks like it next to a line that does too."""
    around = [PLACEHOLDER.sub("x", x) for x in lines[max(k - 1, 0) : k + 2]]
    line = around[min(k, 1)]
    return bool(_SURELY_CODE.match(line)) or sum(bool(_MAYBE_CODE.match(x)) for x in around) > 1 and bool(_MAYBE_CODE.match(line))


def placeholders(text: str) -> list[str]:
    """Placeholders left where values belong; mentions and code don't count."""
    if not any(m in text for m in ("{{", "{%", "<%", "[", "@@", "__", "%", "${", "#{", "<", "«")):
        return []
    out, fence, lines = [], False, text.split("\n")
    for k, line in enumerate(lines):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        if fence or not PLACEHOLDER.search(line):
            continue
        for sentence in _SENTENCE.split(line):
            found = [m[0] for m in PLACEHOLDER.finditer(sentence)]
            if found and not _mentioned(sentence) and not (_CODE_LINE.search(PLACEHOLDER.sub("", sentence)) and _in_code(lines, k)):
                out += found
    return out


def _title(line: str) -> bool:
    return len(line) <= 70 and len(line.split()) <= 8 and line[-1] not in ".!?。！？,;" and not _CONTENT.search(line.lower())


def message(text: str) -> Iterator[str]:
    """The sentences of a document without navigation and footers, titles included."""
    for line in _LINE_END.split(text):
        line = _SPACES.sub(" ", line).strip()
        if not line or not _HAS_WORD.search(line) or _NAVIGATION.match(line):
            continue
        if len(_SEPARATED.findall(line)) >= 2 or (_BULLET.match(line) and _title(line)):
            continue
        yield from filter(None, _SENTENCE.split(line))


def _filler(sentence: str) -> bool:
    """Most words of the sentence are those of filler texts."""
    words = _WORD.findall(sentence.lower())
    n = len(words)
    return n >= 3 and (sum(w in _LOREM for w in words) > 0.8 * n or sum(w in _MASH for w in words) > 0.8 * n)


def kind_of(sentence: str) -> str:
    """filler, known (a phrase of such pages), beside (stands next to one), title, content, open
    (has a sign of content that only a known phrase beside it outweighs) or unknown."""
    low = sentence.lower()
    if _filler(sentence):
        return "filler"
    bare = masked(sentence).rstrip(" .!?。")
    if _STRONG.match(bare) and not _STATES.search(low):
        return "known"
    if _NEXT_TO.match(bare):
        return "beside"
    if _title(sentence):
        return "title"
    if _CONTENT.search(low) or _STATES.search(low):
        return "content"
    return "open" if _OPEN.search(low) else "unknown"


#: Marks the message of a text with unfilled placeholders.
_LEFT_OPEN = "\u27e6\u27e7"


def own_message(text: str | None) -> str | None:
    """What a text says, a sentence a line, without navigation, titles and footers.

    None for texts that have a sentence of content (reading ends there), and
    for null, blank and wordless ones. Of a text with unfilled placeholders
    the message is what they are, whatever else it says.
    """
    if not text or not text.strip():
        return None
    if left := placeholders(text):
        return f"{_LEFT_OPEN} " + "\n".join(left)
    kept = []
    for s in message(text):
        kind = kind_of(s)
        if kind == "content":
            return None
        if kind != "title":
            kept.append(s)
    return "\n".join(kept) or None


def code_of(message_text: str) -> int:
    """Hash of a message with numbers, addresses and dates masked."""
    return xxhash.xxh3_64_intdigest(masked(message_text)) - 2**63


def judge(message_text: str, recurs: bool = False, widely: bool = False) -> str | None:
    """Reason why a group of equal messages is residue, or None.

    recurs: in several documents and sources; widely: in a share of all as well.
    """
    if message_text.startswith(_LEFT_OPEN):
        return "placeholder"
    sentences = message_text.split("\n")
    kinds = [kind_of(s) for s in sentences]
    known, filler, unknown = kinds.count("known"), kinds.count("filler"), kinds.count("unknown") + kinds.count("open")
    if (known or filler) and unknown <= 3:
        words = sum(len(s.split()) for s, k in zip(sentences, kinds) if k in ("unknown", "open"))
        if recurs or unknown == 0 or (known and unknown <= 2 and words <= 25):
            return "message" if known else "filler"
    units = len(_UNIT.findall(message_text))
    if "open" in kinds or not recurs:
        return None
    if units <= _HINT_WORDS and _HINT.search(message_text.lower()):
        return "message"
    return "recurring" if widely and units >= UNKNOWN_WORDS else None


def classify(text: str | None) -> str | None:
    """Reason of one text by itself, as if it stood nowhere else."""
    said = own_message(text)
    return judge(said) if said else None


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_docs: int = RECURRING_DOCS, min_sources: int = RECURRING_SOURCES, share_docs: float = SHARE_DOCS, share_sources: float = SHARE_SOURCES) -> DataFrame:
    """(id, reason, docs, sources) of each document that is residue.

    docs and sources: how many documents and sources have the same normalised
    message; reason is placeholder, message, filler, or recurring for a message
    known by its recurrence alone. Null, empty and blank texts are none; a null
    source counts as one source. Repeated rows come out as often as they come
    in and count each time. Other columns are not read. Only the messages of
    texts without a sentence of content are shuffled, combined before.
    """
    ship_code(df.sparkSession)
    said = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("source", T.StringType()), T.StructField("said", T.StringType()), T.StructField("code", T.LongType())])
    rows = spread(df.select(df[id_col].alias("id"), df[source_col].cast("string").alias("source"), df[text_col].alias("text")).where(F.col("text").rlike(r"\S")), "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(said)
        for batch in batches:
            done = [own_message(t) for t in batch.column(2).to_pylist()]
            take = pa.array([i for i, m in enumerate(done) if m], pa.int32())
            texts = [m for m in done if m]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(texts, pa.string()), pa.array([code_of(m) for m in texts], pa.int64())], schema=out_schema)

    # kept: the rows that may be residue are few, and both the groups and the result need them
    spoken = cut_lineage(rows.mapInArrow(read, said))
    # two-step count: a message of very many documents is first combined per source
    per = spoken.groupBy("code", F.coalesce("source", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("said").alias("said"))
    groups = per.groupBy("code").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("sources"), F.min("said").alias("said"))
    whole = df.groupBy(F.coalesce(df[source_col].cast("string"), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_docs"), F.count(F.lit(1)).alias("all_sources"))
    recurs = (F.col("docs") >= min_docs) & (F.col("sources") >= min_sources)
    widely = (F.col("docs") >= share_docs * F.col("all_docs")) & (F.col("sources") >= share_sources * F.col("all_sources"))
    known = groups.crossJoin(F.broadcast(whole)).select("code", "docs", "sources", "said", recurs.alias("recurs"), widely.alias("widely"))  # whole is one row
    named = T.StructType([T.StructField("code", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("sources", T.LongType()), T.StructField("reason", T.StringType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(named)
        for batch in batches:
            why = pa.array([judge(*x) for x in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), why], schema=out_schema).filter(why.is_valid())

    residue = known.mapInArrow(name, named)
    return spoken.select("id", "code").join(residue, "code").select(F.col("id").alias(id_col), "reason", "docs", "sources")


def without_residue(df: DataFrame, residue: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus without the documents found; rows with a null id stay."""
    return df.join(residue.select(F.col(id_col).alias("__residue")).distinct(), df[id_col] == F.col("__residue"), "left_anti")
