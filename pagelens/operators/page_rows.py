"""Row producers over ``page_signals``: each explodes one array of a page, so they need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions import html as H
from ..functions import structured as J
from ..functions import text as T
from ..functions import urls as U
from ..functions.exprs import any_of, entries, quote, rx, rx_all, rx_sub, strip_edges

WORD = r"[\p{L}\p{N}_]"
EDGE = r"[^\p{L}\p{N}_]"
QUESTION_LINE = rf"(?s)^\s*(?:{'|'.join(fv.QUESTION_OPENERS)})(?:{EDGE}.*)?\?\s*$"
QUESTION_PREFIX = r"(?i)^\s*(?:Q:|Question:|FAQ:)"
ANSWER_PREFIX = r"(?i)^\s*(?:A:|Answer:)"
SENTENCE_QUESTION = rf"(?i)(?:{'|'.join(fv.SENTENCE_OPENERS)})\s+[^?]*\?"
HEADING_START = rf"(?i)<h[1-6](?:\s{H.INSIDE})?>"
HEADING_NAME = "^h[1-6]$"
MARK = "\u0001"

c = F.col


def _rows(signals: DataFrame, array: Column, *keep: str) -> DataFrame:
    """``page_id, site, <keep>, <fields of the array's struct>``, one row per array entry."""
    cols = ["page_id", "site", *keep]
    return signals.select(*cols, F.explode(entries(array)).alias("_r")).select(*cols, "_r.*")


def _value_rows(signals: DataFrame, array: Column, name: str) -> DataFrame:
    return signals.select("page_id", "site", F.explode(entries(array)).alias(name))


# --- headings, links, images, head ---------------------------------------------------------------
def heading_rows(signals: DataFrame) -> DataFrame:
    return _rows(signals, c("headings"))


def page_links(signals: DataFrame, mode: str = "site") -> DataFrame:
    """Distinct links per page.

    mode ``site``: fragment dropped, internal when the registrable domain is the same; ``netloc``: full URL of
    the same host; ``path_only``: same host, query and fragment dropped; ``no_images``: fragment dropped, links
    with a foreign scheme or host and links to images left out.
    """
    if mode == "site":
        return _rows(signals, c("links"))
    based = signals.select(
        "page_id", "site", "netloc", "anchors", *[v.alias(f"_b_{k}") for k, v in U.base_parts("base_url").items()])
    parts = {k: c(f"_b_{k}") for k in ("scheme", "root", "dir", "plain", "bare")}
    full = F.transform("anchors", lambda a: F.struct(
        a["href"].alias("href"), U.resolve_with(parts, a["href"]).alias("url")))
    resolved = based.select("page_id", "site", "netloc", full.alias("_full"))
    if mode == "netloc":
        kept, out = (lambda r: U.netloc(r["url"]) == c("netloc")), (lambda r: r["url"])
    elif mode == "path_only":
        kept = lambda r: ~r["href"].rlike(r"^(?:javascript:|mailto:|tel:|#|data:)") & (
            U.netloc(r["url"]) == c("netloc"))
        out = lambda r: rx_sub(r["url"], r"(?s)[?#].*$")
    elif mode == "no_images":
        ext = "|".join(quote(e) for e in fv.IMAGE_EXTENSIONS)
        kept = lambda r: (F.contains(r["href"], c("netloc")) | ~r["href"].contains(":")) & ~r["url"].rlike(
            rf"(?:{ext})$")
        out = lambda r: U.strip_fragment(r["url"])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _value_rows(resolved, F.array_distinct(F.transform(F.filter("_full", kept), out)), "url")


def image_rows(signals: DataFrame) -> DataFrame:
    return _rows(signals, c("images"))


def alt_issues(signals: DataFrame, variant: str = "default") -> DataFrame:
    """Images with a missing or weak alternative text."""
    if variant == "short":
        bad, weak = (lambda i: F.length(i["alt"]) < 5), "weak"
    else:
        bad, weak = _weak_alt, "weak"
    return _rows(signals, _alt_issues(bad, weak))


def _weak_alt(i: Column) -> Column:
    return (F.length(i["alt"]) < 3) | F.lower(i["alt"]).isin(fv.WEAK_ALTS)


def _alt_issues(bad, weak: str) -> Column:
    return F.transform(
        F.filter("images", bad),
        lambda i: F.struct(i["src"].alias("src"), i["alt"].alias("alt"),
                           F.when(i["alt"] == "", F.lit("missing")).otherwise(F.lit(weak)).alias("issue")))


def alt_issue_texts() -> Column:
    return F.transform(_alt_issues(_weak_alt, "weak"), lambda i: F.concat_ws(" ", i["issue"], i["src"]))


def hreflang_pairs(signals: DataFrame) -> DataFrame:
    return _rows(signals, c("hreflang"), "url")


def geo_signal_rows(signals: DataFrame) -> DataFrame:
    """hreflang links, ``geo.`` metas and LocalBusiness blocks as one long table."""
    return _rows(signals, _geo_signals())


def _geo_signals() -> Column:
    def row(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), name.alias("name"), value.alias("value"))

    return F.concat(
        F.transform("hreflang", lambda h: row("hreflang", h["hreflang"], h["href"])),
        F.transform(F.filter("geo_meta", lambda m: F.lower(m["name"]).contains("geo.")),
                    lambda m: row("geo_meta", m["name"], m["content"])),
        F.transform(J.blocks_of_type("jsonld", "LocalBusiness"),
                    lambda b: row("LocalBusiness_schema", F.coalesce(F.get_json_object(b, "$.name"), F.lit("")),
                                  F.coalesce(F.get_json_object(b, "$.address.addressLocality"), F.lit("")))),
    )


def geo_signal_texts() -> Column:
    return F.transform(_geo_signals(), lambda g: F.concat_ws(" ", g["type"], g["name"], g["value"]))


def geo_meta_map(metas: Column) -> Column:
    """MAP name→content; the last tag of a name wins."""
    names = F.array_distinct(F.transform(metas, lambda m: F.lower(m["name"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(metas, lambda m: F.lower(m["name"]) == n), -1)["content"]))


def map_embeds(signals: DataFrame) -> DataFrame:
    return _rows(signals, c("maps"))


def jsonld_type_rows(signals: DataFrame) -> DataFrame:
    return _value_rows(signals, c("jsonld_types"), "type").groupBy("page_id", "site", "type").agg(
        F.count(F.lit(1)).alias("n"))


def page_warnings(signals: DataFrame) -> DataFrame:
    return signals.select("page_id", "site", F.posexplode(entries("warnings")).alias("pos", "warning"))


def social_and_device_tags(signals: DataFrame) -> DataFrame:
    """og tags, viewport and charset with presence flags."""
    def og(name: str) -> Column:
        return F.exists("og", lambda o: F.lower(o["name"]) == name)

    return signals.select(
        "page_id", "site", F.size("og").cast("bigint").alias("n_og"), og("og:title").alias("has_og_title"),
        og("og:description").alias("has_og_description"), og("og:image").alias("has_og_image"),
        c("viewport").isNotNull().alias("has_viewport"), F.coalesce("charset", F.lit("")).alias("charset"))


def performance_hints(signals: DataFrame, image_bytes: DataFrame | None = None) -> DataFrame:
    """HTML bytes, lazy images, images without both dimensions; byte sums when ``image_bytes(src, bytes)`` is given."""
    hints = signals.select(
        "page_id", "site", "html_bytes", F.size("images").cast("bigint").alias("n_images"),
        F.size(F.filter("images", lambda i: i["loading"] == "lazy")).cast("bigint").alias("images_lazy"),
        F.size(F.filter("images", lambda i: (F.coalesce(i["width"], F.lit("")) == "")
                        | (F.coalesce(i["height"], F.lit("")) == ""))).cast("bigint").alias("images_no_dimensions"),
        F.size(F.filter("images", lambda i: i["alt"] == "")).cast("bigint").alias("images_missing_alt"),
    )
    if image_bytes is None:
        return hints
    src = signals.select("page_id", F.explode(F.array_distinct(F.transform("images", lambda i: U.resolve_url(
        c("base_url"), i["src"])))).alias("src"))
    sizes = image_bytes.groupBy("src").agg(F.max("bytes").alias("bytes"))  # one row per image; logos are on every page
    sums = src.join(sizes, "src").groupBy("page_id").agg(F.sum("bytes").alias("image_bytes"))
    return hints.join(sums, "page_id", "left").withColumn("image_bytes", F.coalesce("image_bytes", F.lit(0)))


def snippet_profile(signals: DataFrame) -> DataFrame:
    return signals.select("page_id", "site", "n_lists", "n_tables", "n_short_p", snippet_score().alias("snippet_score"))


def snippet_score() -> Column:
    return F.least(F.lit(100), c("n_lists") * 10 + c("n_tables") * 15 + c("n_short_p") * 2).cast("bigint")


def snippet_suitable(text: Column) -> Column:
    ends = F.endswith(F.trim(text), F.lit("?"))
    return (F.coalesce(text, F.lit("")) != "") & (ends | any_of(text, fv.SNIPPET_MARKERS))


def meta_profile(signals: DataFrame) -> DataFrame:
    m = F.coalesce("meta_raw", F.lit(""))
    return signals.select(
        "page_id", "site", (m != "").alias("present"), F.length(m).cast("bigint").alias("length"),
        F.length(m).between(150, 160).alias("optimal_length"), snippet_suitable(m).alias("snippet_suitable"))


def nap(signals: DataFrame) -> DataFrame:
    """Name, address and phone: on the page, in its text, and in its JSON-LD."""
    return signals.select(
        "page_id", "site", "phone", "address", "title", "text_phone", "text_address",
        J.last_value("jsonld", "$.name").alias("schema_name"),
        J.last_value("jsonld", "$.address").alias("schema_address"),
        J.last_value("jsonld", "$.telephone").alias("schema_phone"))


# --- questions -----------------------------------------------------------------------------------
def faq_schema_pairs(signals: DataFrame) -> DataFrame:
    return _rows(signals, J.faq_entities("jsonld"))


def _marked_pairs(text: Column, q_mark: str, a_mark: str) -> Column:
    pieces = F.split(rx_sub(text, rf"(?i){q_mark}", MARK), MARK)
    rows = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.struct(
        strip_edges(rx(p, rf"(?is)^(.*?){a_mark}")).alias("question"),
        strip_edges(rx(p, rf"(?is)^.*?{a_mark}(.*)$")).alias("answer")))
    return F.filter(rows, lambda r: (r["question"] != "") & (r["answer"] != ""))


PAIR = "array<struct<question:string,answer:string>>"


def _sentence_pairs(text: Column, to_end: bool) -> Column:
    """Text up to a question mark, with what follows up to the next paragraph or line that starts with a letter.

    The text is cut at those line ends once; one fold over the pieces carries the question that is still open.
    ``to_end``: the last piece counts as an answer too, although no line end follows it.
    """
    marked = rx_sub(rx_sub(text, r"\n(\n|[A-Za-z])", MARK + "\n$1"), r"\n(\n)", MARK + "$1")
    pieces = F.split(marked, MARK)
    pieces = pieces if to_end else F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("asked"), F.array().cast(PAIR).alias("pairs"))

    def step(state: Column, piece: Column) -> Column:
        whole = F.concat(state["open"], piece)
        has_mark = whole.rlike(r"(?s)^.[^?]*\?")
        question = strip_edges(rx(whole, r"(?s)^(.[^?]*)\?"))
        rest = strip_edges(rx(whole, r"(?s)^.[^?]*\?(.*)$"))
        done = has_mark & (rest != "")
        return F.struct(
            F.when(done, F.lit("")).otherwise(whole).alias("open"),
            has_mark.alias("asked"),
            F.when(done, F.concat(state["pairs"], F.array(F.struct(
                question.alias("question"), rest.alias("answer"))))).otherwise(state["pairs"]).alias("pairs"),
        )

    return F.aggregate(pieces, start, step)["pairs"]


def text_pairs(text: Column, to_end: bool = True) -> Column:
    """``Q:/A:``, ``Question:/Answer:`` and sentence pairs of a text."""
    return F.concat(_marked_pairs(text, "Q:", "A:"), _marked_pairs(text, "Question:", "Answer:"),
                    _sentence_pairs(text, to_end))


def faq_text_pairs(signals: DataFrame, kinds: str = "all", text: str = "text", to_end: bool = True) -> DataFrame:
    arrays = {
        "all": lambda: text_pairs(c(text), to_end),
        "q": lambda: _marked_pairs(c(text), "Q:", "A:"),
        "question": lambda: _marked_pairs(c(text), "Question:", "Answer:"),
        "sentence": lambda: _sentence_pairs(c(text), to_end),
    }
    return _rows(signals, arrays[kinds]())


def faq_headings(signals: DataFrame) -> DataFrame:
    """Question headings, then question lines with the line that follows; first 25 distinct per page."""
    lines = F.filter(F.transform(F.split(H.block_text("markup"), "\n"), lambda s: F.trim(rx_sub(s, r"\s+", " "))),
                     lambda s: s != "")

    def asks(s: Column) -> Column:
        return F.lower(s).rlike(QUESTION_LINE) | s.rlike(QUESTION_PREFIX)

    pre = signals.select("page_id", "site", "h2", "h3", lines.alias("_lines"))
    from_headings = F.transform(F.filter(F.concat("h2", "h3"), asks),
                                lambda h: F.struct(h.alias("question"), F.lit("").alias("answer")))
    numbered = F.filter(
        F.transform("_lines", lambda s, i: F.struct(s.alias("s"), F.coalesce(
            F.get(c("_lines"), i + 1), F.lit("")).alias("next"))),
        lambda r: asks(r["s"]))
    from_lines = F.transform(numbered, lambda r: F.struct(
        F.trim(rx_sub(r["s"], QUESTION_PREFIX)).alias("question"),
        F.trim(rx_sub(r["next"], ANSWER_PREFIX)).alias("answer")))
    found = pre.select("page_id", "site", F.concat(from_headings, from_lines).alias("_all"))
    # keep the first entry of every question, case-insensitively, inside the row
    keys = F.transform("_all", lambda r: F.lower(r["question"]))
    firsts = found.select("page_id", "site", "_all", keys.alias("_keys"))
    uniq = F.filter("_all", lambda r, i: (r["question"] != "")
                    & (F.array_position("_keys", F.lower(r["question"])) == i + 1))
    return firsts.select("page_id", "site", F.posexplode(F.slice(uniq, 1, fv.MAX_FAQ_PER_PAGE)).alias("pos", "_r")
                         ).select("page_id", "site", "pos", "_r.*")


def section_pairs(markup: Column) -> Column:
    """Questions in headings of FAQ sections with the text of the heading's next sibling element.

    Sections are ``div``, ``section`` and ``article`` elements whose text has a FAQ word; a heading counts once for each that
    holds it, however deep.  Pages without a FAQ word in their markup are not read further.
    """
    def pairs(stream: Column) -> Column:
        found = H.elements(stream, lambda name: name.isin("div", "section", "article") | name.rlike(HEADING_NAME))
        return H.bound(found, lambda es: of_elements(stream, es))

    def of_elements(stream: Column, es: Column) -> Column:
        sections = F.array_sort(F.filter(es, lambda x: x["name"].isin("div", "section", "article")),
                                lambda x, y: x["i"] - y["i"])
        sections = F.filter(sections, lambda x: any_of(F.lower(H.text_between(stream, x["i"], x["j"])), fv.FAQ_WORDS))
        answers = F.filter(es, lambda x: x["after"].isNotNull())
        heads = F.array_sort(F.filter(es, lambda x: x["name"].rlike(HEADING_NAME)), lambda x, y: x["i"] - y["i"])
        rows = F.transform(heads, lambda h: F.struct(
            h["i"].alias("i"), h["j"].alias("j"), strip_edges(H.text_between(stream, h["i"], h["j"])).alias("question"),
            F.get(F.transform(F.filter(answers, lambda x: x["after"] == h["i"]),
                              lambda x: strip_edges(H.text_between(stream, x["i"], x["j"]))), F.lit(0)).alias("full")))
        kept = F.filter(rows, lambda r: (r["full"] != "") & (
            F.endswith(r["question"], F.lit("?")) | any_of(F.lower(r["question"]), fv.SECTION_QUESTION_WORDS)))
        short = F.transform(kept, lambda r: F.struct(
            r["i"].alias("i"), r["j"].alias("j"), r["question"].alias("question"),
            F.when(F.length(r["full"]) > 200, F.concat(F.substring(r["full"], 1, 200), F.lit("...")))
            .otherwise(r["full"]).alias("answer")))
        return H.bound(short, lambda all_pairs: F.flatten(F.transform(sections, lambda s: F.transform(
            F.filter(all_pairs, lambda r: (r["i"] > s["i"]) & (r["j"] <= s["j"])),
            lambda r: F.struct(r["question"].alias("question"), r["answer"].alias("answer"))))))

    may = any_of(F.lower(H.decode_entities(rx_sub(markup, H.ANY_TAG))), fv.FAQ_WORDS) & markup.rlike(HEADING_START)
    return F.when(may, H.bound(H.tag_stream(markup), pairs)).otherwise(F.array().cast(PAIR))


def faq_sections(signals: DataFrame) -> DataFrame:
    return _rows(signals, section_pairs(c("markup")))


def faq_questions(signals: DataFrame) -> DataFrame:
    """FAQPage names, then the first five question sentences of the text."""
    names = F.transform(J.faq_entities("jsonld"), lambda e: e["question"])
    sentences = F.slice(rx_all("text", SENTENCE_QUESTION), 1, 5)
    return _value_rows(signals, F.concat(names, sentences), "question")


def faq_topics(signals: DataFrame) -> DataFrame:
    """Headings h1–h4 with a question mark, plus FAQPage names."""
    heads = F.filter("headings", lambda h: (h["level"] <= 4) & h["text"].contains("?"))
    topics = F.filter(F.transform(heads, lambda h: F.trim(F.replace(h["text"], F.lit("?"), F.lit("")))),
                      lambda t: (F.length(t) > 5) & (F.length(t) < 100))
    names = F.filter(F.transform(J.faq_entities("jsonld"), lambda e: e["question"]), lambda q: q != "")
    return _value_rows(signals, F.concat(topics, names), "topic")


def question_headings_array(lang: str) -> Column:
    words = fv.QUESTION_WORDS_BY_LANG.get(lang, fv.QUESTION_WORDS_BY_LANG["en"])
    return F.filter("headings", lambda h: any_of(F.lower(h["text"]), words)
                    | F.endswith(h["text"], F.lit("?")))


def question_headings(signals: DataFrame, lang: str = "en") -> DataFrame:
    return _rows(signals, question_headings_array(lang))


# --- products, topics, competitors ---------------------------------------------------------------
def products(signals: DataFrame, variant: str = "short") -> DataFrame:
    """Distinct product names per page: ``short`` headings <50, ``worded`` headings with product words,
    ``long`` headings <100."""
    return _value_rows(signals, product_names(variant), "product")


def product_names(variant: str = "short") -> Column:
    heads = F.transform(F.filter("headings", lambda h: h["level"] <= 3), lambda h: h["text"])
    if variant == "short":
        heads = F.filter(heads, lambda t: F.length(t) < 50)
    elif variant == "worded":
        heads = F.filter(heads, lambda t: any_of(F.lower(t), fv.PRODUCT_HEADING_WORDS))
    else:
        heads = F.filter(heads, lambda t: F.length(t) < 100)
    named = F.transform(J.blocks_of_type("jsonld", "Product"), lambda b: F.coalesce(
        F.get_json_object(b, "$.name"), F.lit("")))
    names = F.concat(named, heads)
    least = {"short": 3, "worded": 0, "long": 1}[variant]
    return F.array_distinct(F.filter(names, lambda p: F.length(p) >= least))


def page_topics(signals: DataFrame, k: int = 10) -> DataFrame:
    """Ten most frequent topic words of a page; words of the title count even when they are stop words."""
    ranked = with_topics(signals, "page_id", "site", k=k)
    return ranked.select("page_id", "site", F.posexplode(entries("_topics")).alias("_p", "_t")).select(
        "page_id", "site", "_t.topic", "_t.n", (c("_p") + 1).alias("rank"))


def with_topics(signals: DataFrame, *keep: str, k: int = 10) -> DataFrame:
    """``keep`` and ``_topics``: the ``k`` most frequent topic words of a page, counted inside the row.

    Words are sorted, so equal ones form a run, and a run's length is the distance to the next run's start.
    """
    words = T.topic_words("text")
    pool = F.concat(T.without_stop_words(words, fv.TOPIC_STOP_WORDS), T.topic_words("title"))
    pre = signals.select(*keep, F.sort_array(pool).alias("_s"))  # native order; array_sort compares by an interpreted lambda
    places = F.transform("_s", lambda w, i: i)
    starts = F.filter(places, lambda i: (i == 0) | (F.get("_s", i - 1) != F.get("_s", i)))
    runs = pre.select(*keep, "_s", starts.alias("_at"))
    counted = F.transform("_at", lambda a, j: F.struct(
        (a - F.coalesce(F.get("_at", j + 1), F.size("_s"))).alias("_less"), F.get("_s", a).alias("topic")))
    top = F.slice(F.array_sort(counted), 1, k)
    return runs.select(*keep, F.transform(top, lambda r: F.struct(
        r["topic"].alias("topic"), (-r["_less"]).cast("bigint").alias("n"))).alias("_topics"))


def heading_topics(signals: DataFrame) -> DataFrame:
    """First ten short headings of a page in lower case."""
    heads = F.transform(F.filter("headings", lambda h: h["level"] <= 3), lambda h: F.lower(h["text"]))
    return _value_rows(signals, F.array_distinct(F.slice(F.filter(heads, lambda t: F.length(t) < 50), 1, 10)), "topic")


def comparison_phrases(low: Column) -> Column:
    """Distinct "word keyword word" phrases of a lower-cased text, which should be a column of its own.

    A text without the keyword is not searched.  Words are taken whole, from their start on, so that the search
    never goes back into one and long words cost no more than others.
    """
    none = F.array().cast("array<string>")
    found = [F.when(F.contains(low, F.lit(k)), rx_all(low, rf"(?<!{WORD}){WORD}++\s++{k}\s++{WORD}++")).otherwise(none) for k in fv.COMPARISON_KEYWORDS]
    return F.array_distinct(F.concat(*found))


def competitor_phrases(signals: DataFrame, variant: str = "phrase") -> DataFrame:
    if variant == "phrase":
        signals = signals.withColumn("_low", F.lower("text"))
        arr = comparison_phrases(c("_low"))
    elif variant == "after":
        signals = signals.withColumn("_low", F.lower("text"))
        arr = F.array_distinct(F.concat(*[
            rx_all(c("_low"), rf"{k.replace(' ', chr(92) + 's+')}\s+({WORD}+)", 1) for k in fv.COMPARISON_MARKERS]))
    else:
        arr = next_words(c("text"))
    return _value_rows(signals, arr, "competitor")


def next_words(text: Column) -> Column:
    """The word that follows each comparison word, first three."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                    lambda r: F.lower(r["w"]).isin(fv.COMPARISON_WORDS))
    nxt = F.filter(F.transform(hits, lambda r: F.get(words, r["i"] + 1)), lambda w: w.isNotNull())
    return F.slice(nxt, 1, 3)


# --- plain-text lines ----------------------------------------------------------------------------
def _lines(text: Column, n: int) -> Column:
    return F.transform(F.slice(F.split(text, "\n"), 1, n), lambda s: F.trim(s))


def text_headings(texts: DataFrame, key: str, text: str = "text", order: str = "page_id", k: int = 10) -> DataFrame:
    """Lines among the first 20 that start with # or are all capitals; first ten per key."""
    hits = F.filter(_lines(c(text), 20), lambda s: F.startswith(s, F.lit("#")) | (
        (F.length(s) > 10) & (s == F.upper(s)) & (s != F.lower(s))))
    rows = texts.select(key, order, F.posexplode(hits).alias("pos", "heading"))
    w = Window.partitionBy(key).orderBy(order, "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def product_lines(texts: DataFrame, key: str, text: str = "text", order: str = "page_id", k: int = 5) -> DataFrame:
    """Lines among the first 10 that hold a product word; first five per key."""
    hits = F.filter(_lines(c(text), 10), lambda s: any_of(F.lower(s), fv.PRODUCT_LINE_WORDS))
    rows = texts.where(any_of(F.lower(text), fv.PRODUCT_LINE_GATE)).select(
        key, order, F.posexplode(hits).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy(order, "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def content_pages(signals: DataFrame) -> DataFrame:
    """Pages that are no technical files; sites with nothing else keep what the lenient rule allows.

    Only technical pages are looked up by site; all others pass straight through.
    """
    content = signals.where(~U.is_technical("url"))
    doubtful = signals.where(U.is_technical("url") & ~U.is_technical_strict("url"))
    return content.unionByName(doubtful.join(content.select("site").distinct(), "site", "left_anti").select(signals.columns))
