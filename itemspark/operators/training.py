"""Training sets: supervised rows, preference rows, example candidates, encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark import skew
from itemspark.functions import chat
from itemspark.functions import fixed_values as V
from itemspark.functions.text import WHITE, est_tokens, seeded_order
from itemspark.operators.parse import extract_json
from itemspark.operators.validate import validate_schema
from itemspark.session import ship
from itemspark.skew import settle

ship(__name__)


# ---- rows -------------------------------------------------------------------
def sft_from_chats(chats: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Chats of three or more messages that end with the assistant, as one text each."""
    last = F.try_element_at("messages", F.lit(-1))
    usable = chats.filter((F.size("messages") >= 3) & (last["role"] == "assistant"))
    return usable.select(
        *keep, chat.chat_text(F.col("messages")).alias("text"), F.lit("instruction_following").alias("source"), "question_id",
        "recipe_id", F.lit(None).cast("double").alias("quality_score"), chat.has_think(last["content"]).alias("has_think_chain"),
    )


def _whole_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("prompt is not null and chosen is not null and rejected is not null")


def sft_from_pairs(pairs: DataFrame, keep: Sequence[str] = (), default_score: float = 0.9) -> DataFrame:
    """The chosen side of every complete preference pair."""
    text = F.concat(chat.chat_text(F.col("prompt")), chat.reply_text(F.col("chosen.content")))
    none = F.lit(None).cast("string")
    return _whole_pairs(pairs).select(
        *keep, text.alias("text"), F.lit("dpo_chosen").alias("source"), none.alias("question_id"), none.alias("recipe_id"),
        F.coalesce("metadata.chosen_score", F.lit(default_score)).alias("quality_score"),
        chat.has_think(F.col("chosen.content")).alias("has_think_chain"),
    )


def build_sft(chats: DataFrame, pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return sft_from_chats(chats, keep).unionByName(sft_from_pairs(pairs, keep))


def build_dpo(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prompt text, both replies, and their scores with defaults."""
    return _whole_pairs(pairs).select(
        *keep, chat.chat_text(F.col("prompt")).alias("prompt"), F.col("chosen.content").alias("chosen"),
        F.col("rejected.content").alias("rejected"), F.coalesce("metadata.chosen_score", F.lit(0.9)).alias("chosen_score"),
        F.coalesce("metadata.rejected_score", F.lit(0.5)).alias("rejected_score"),
        F.coalesce("metadata.difficulty", F.lit("medium")).alias("difficulty"),
    )


def _item_as_written(parsed: DataFrame) -> DataFrame:
    """Item columns exactly as the response has them."""
    get = lambda n, k="string": F.try_variant_get("parsed", f"$.{n}", k)
    return parsed.withColumns(
        {
            "id": get("id"), "type": get("type"), "question": get("question"), "answer": get("answer"),
            "answer_options": get("answer_options", "map<string,string>"),
            "acceptable_answers": F.coalesce(get("acceptable_answers", "array<string>"), F.when(get("acceptable_answers") != "", F.array(get("acceptable_answers")))),
            "answer_explanation": get("answer_explanation"), "difficulty": get("difficulty"), "image_url": get("image_url", "array<string>"),
        }
    ).drop("parsed")


def example_candidates(
    samples: DataFrame, key: str, reply: Column, user: Column, score: Column, source: str, standard: Column | None = None
) -> DataFrame:
    """Valid items found in replies, with the standard named in the user's text (or in ``standard``)."""
    base = settle(samples.select(
        key, user.alias("user_prompt"), reply.alias("_reply"), score.alias("score"),
        (F.lit(None).cast("string") if standard is None else standard).alias("_given"),
    ))
    found = extract_json(base.filter("user_prompt <> '' and trim(_reply) <> ''"), "_reply").filter("parsed is not null")
    named = F.coalesce("_given", chat.standard_in_text(F.col("user_prompt")), F.lit("unknown"))
    items = settle(_item_as_written(found).withColumn("standard", named))
    good = validate_schema(items).filter("reject_reason is null")
    fields = ["id", "type", "question", "answer", "answer_options", "acceptable_answers", "answer_explanation", "image_url"]
    return good.select(
        key, "user_prompt", "standard", F.coalesce("difficulty", F.lit("medium")).alias("difficulty"), "score",
        F.lit(source).alias("source"), F.struct(*fields).alias("item"),
    )


def candidates_from_chats(chats: DataFrame, key: str) -> DataFrame:
    usable = chats.filter(F.size("messages") >= 3)
    m = F.col("messages")
    return example_candidates(
        usable, key, chat.last_content(m, "assistant"), chat.last_content(m, "user"), F.lit(1.0), "messages"
    )


def candidates_from_pairs(pairs: DataFrame, key: str, max_chars: int | None = None) -> DataFrame:
    usable = pairs.filter("prompt is not null and chosen is not null")
    return example_candidates(
        usable, key, F.col("chosen.content"), chat.prompt_user(F.col("prompt"), "last", max_chars),
        F.coalesce("metadata.chosen_score", F.lit(0.5)), "dpo", F.col("metadata.standard"),
    )


# ---- encodings --------------------------------------------------------------
PAD, UNKNOWN, _FIRST_ID, _HOT = 0, 1, 2, 100_000
_SHIFT = 17  # bits that hold the id of a frequent word: _FIRST_ID + _HOT is below 2 ** 17


def _cut(text: Column) -> Column:
    """The same as ``words``; one plain space is found faster than a class of white space."""
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")


def build_vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """Word ids by falling frequency, then word; 0 pads and 1 is unknown."""
    counts = texts.select(F.explode(_cut(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return skew.dense_number(counts, ["-n", "token"], "token_id", start=_FIRST_ID)


def _ids(texts: DataFrame, keys: Sequence[str], text: str, vocabulary: DataFrame, max_len: int | None) -> DataFrame:
    """Token ids in order, at most ``max_len`` if it is given, one array per (unique) key.

    Whole texts are dealt by their key, once. The most frequent words (a fixed
    number of rows) are looked up by broadcast and gathered where their text is;
    only the others leave it, once per text with their places, to meet the
    vocabulary in a shuffle. The key is one column that is never null, so no
    join by it moves the texts again.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.struct(*keys).alias("_k"), F.col(text).alias("_t")).repartition(parts, "_k")
    cut = _cut(F.col("_t"))
    placed = rows.select("_k", F.posexplode_outer(cut if max_len is None else F.slice(cut, 1, max_len)).alias("_i", "token"))
    hot = vocabulary.filter(F.col("token_id") < _FIRST_ID + _HOT).select("token", F.col("token_id").alias("_id"))
    rare = vocabulary.filter(F.col("token_id") >= _FIRST_ID + _HOT).select("token", "token_id")
    here = F.shiftleft(F.col("_i").cast("long"), _SHIFT) + F.col("_id")  # place and id in one number, null for other words
    own = placed.join(F.broadcast(hot), "token", "left").groupBy("_k").agg(F.collect_list(here).alias("_own"))

    away = placed.filter("token IS NOT NULL").join(F.broadcast(hot), "token", "left_anti").groupBy("_k", "token").agg(F.collect_list("_i").alias("_at"))
    known = F.coalesce("token_id", F.lit(UNKNOWN).cast("long"))
    back = away.join(rare, "token", "left").select("_k", F.transform("_at", lambda i: F.struct(i.alias("_i"), known.alias("_id"))).alias("_f"))
    found = back.groupBy("_k").agg(F.flatten(F.collect_list("_f")).alias("_found"))
    both = own.join(found, "_k", "left")
    stayed = F.transform("_own", lambda n: F.struct(F.shiftright(n, _SHIFT).cast("int").alias("_i"), n.bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("_id")))
    every = F.sort_array(F.concat(stayed, F.coalesce("_found", F.array().cast("array<struct<_i:int,_id:bigint>>"))))
    return both.select(*[F.col("_k")[k].alias(k) for k in keys], F.transform(every, lambda e: e["_id"]).alias("ids"))


def _padded(ids: Column, max_len: int | None, pad_to: int) -> tuple[Column, Column]:
    """Ids and mask, padded to ``max_len``, or without it to the next multiple of ``pad_to``, the end of the row's bucket."""
    gap = F.pmod(-F.size(ids), F.lit(pad_to)) if max_len is None else F.lit(max_len) - F.size(ids)
    return (
        F.concat(ids, F.array_repeat(F.lit(PAD).cast("long"), gap)),
        F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap)),
    )


def _labelled(coded: DataFrame) -> DataFrame:
    labels = F.zip_with("input_ids", "attention_mask", lambda i, m: F.when(m == 0, F.lit(V.IGNORED_LABEL).cast("long")).otherwise(i))
    return coded.withColumn("labels", labels)


def encode_sft(texts: DataFrame, keys: Sequence[str], vocabulary: DataFrame, max_len: int | None = None, text: str = "text", pad_to: int = 64) -> DataFrame:
    """input_ids, attention_mask and labels; labels ignore exactly the masked places.

    Texts are whole and padded to their bucket unless ``max_len`` gives all rows one length.
    """
    ids, mask = _padded(F.col("ids"), max_len, pad_to)
    return _labelled(_ids(texts, keys, text, vocabulary, max_len).select(*keys, ids.alias("input_ids"), mask.alias("attention_mask")))


def encode_dpo(pairs: DataFrame, key: str, vocabulary: DataFrame, max_len: int | None = None, pad_to: int = 64) -> DataFrame:
    """Ids and mask for prompt, chosen and rejected."""
    sides = ["prompt", "chosen", "rejected"]
    entries = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in sides]))
    long = pairs.select(key, entries.alias("e")).select(key, "e.*")
    ids, mask = _padded(F.col("ids"), max_len, pad_to)
    coded = _ids(long, [key, "side"], "text", vocabulary, max_len).select(key, "side", ids.alias("i"), mask.alias("m"))
    pick = lambda s, c: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True)
    return coded.groupBy(key).agg(
        *[pick(s, c).alias(f"{s}_{n}") for s in sides for c, n in (("i", "input_ids"), ("m", "attention_mask"))]
    )


def encode_with(texts: DataFrame, key: str, tokenize: Callable[[str], list[int]], max_len: int = 2048, text: str = "text") -> DataFrame:
    """The same shape with a caller's tokenizer, in Arrow batches."""

    def batches(parts: Iterator) -> Iterator:
        for part in parts:
            ids = [list(tokenize(t or ""))[:max_len] for t in part[text]]
            yield part[[key]].assign(ids=ids)

    kind = texts.schema[key].dataType.simpleString()
    ids, mask = _padded(F.col("ids"), max_len, 1)
    coded = texts.select(key, text).mapInPandas(batches, f"{key} {kind}, ids array<bigint>")
    return _labelled(coded.select(key, ids.alias("input_ids"), mask.alias("attention_mask")))


# ---- size and split ---------------------------------------------------------
def augment_to(samples: DataFrame, target: int, choices: dict[str, Sequence[str]], seed: int = 42) -> DataFrame:
    """Add template rows until there are ``target``; each takes one seeded value per choice."""
    short = target - samples.count()
    have = samples.select("text", F.lit(False).alias("is_added"), *[F.col(c) if c in samples.columns else F.lit(None).cast("string").alias(c) for c in choices])
    if short <= 0:
        return have
    drawn = samples.sparkSession.range(short)
    for i, (name, values) in enumerate(choices.items()):
        at = F.pmod(seeded_order(seed + i, F.col("id")), F.lit(len(values))).cast("int")
        drawn = drawn.withColumn(name, F.get(F.array(*map(F.lit, values)), at))
    parts = [F.concat(F.lit(f"{n}: "), F.col(n)) for n in choices]
    text = F.concat(F.lit(f"{V.CHAT_OPEN}user\nWrite one question. "), F.concat_ws("; ", *parts), F.lit(f"{V.CHAT_CLOSE}\n"))
    return have.unionByName(drawn.select(text.alias("text"), F.lit(True).alias("is_added"), *choices))


def split(df: DataFrame, keys: Sequence[str], share: float = 0.9, seed: int = 42) -> DataFrame:
    """Tell train from held-out rows by their key alone, so the split survives any repartition."""
    place = F.pmod(seeded_order(seed, *[F.col(k) for k in keys]), F.lit(1000))
    return df.withColumn("is_train", place < int(round(share * 1000)))


def length_buckets(df: DataFrame, text: str = "text", width: int = 64) -> DataFrame:
    """Rows of similar length side by side: range partitions sorted by estimated tokens."""
    out = df.withColumn("n_tokens", est_tokens(F.coalesce(text, F.lit(""))))
    out = out.withColumn("bucket", F.floor(F.col("n_tokens") / width))
    # the hash divides the rows of a frequent length among range partitions
    return out.repartitionByRange("n_tokens", F.xxhash64(text)).sortWithinPartitions("n_tokens")


def padding_report(bucketed: DataFrame) -> DataFrame:
    """Tokens wasted when every bucket is padded to its longest row."""
    got = bucketed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("n_tokens")
    )
    return got.withColumn("n_padding", F.col("n_rows") * F.col("longest") - F.col("n_tokens"))


