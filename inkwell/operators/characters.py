"""The character dimension: merging, registering, resolving, pronouns and gender, voices, review."""



from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import fuzzy, ranks

# Pronouns by category and by gender.
PRONOUNS = {"subject": ("he", "she", "they", "it"), "object": ("him", "her", "them", "it"), "possessive": ("his", "her", "their", "its"), "possessive_pronoun": ("his", "hers", "theirs"), "reflexive": ("himself", "herself", "themselves", "itself")}
MALE, FEMALE, NEUTRAL = ("he", "him", "his", "himself"), ("she", "her", "hers", "herself"), ("they", "them", "their", "theirs", "themselves")
PREFERRED = {"male": ("he", "him", "his", "his", "himself"), "female": ("she", "her", "her", "hers", "herself"), "neutral": ("they", "them", "their", "theirs", "themselves")}
# Emotions as (name, speed, pitch, volume).
EMOTIONS = (("neutral", 1.0, 0.0, 0.0), ("happy", 1.1, 1.0, 0.0), ("sad", 0.9, -1.0, 0.0), ("angry", 1.15, 1.5, 2.0), ("fearful", 1.2, 0.0, 0.0), ("surprised", 1.1, 2.0, 0.0), ("disgusted", 0.95, -0.5, 0.0), ("whispering", 0.85, 0.0, -3.0))
VOICES = ("af_heart", "af_bella", "af_nicole", "af_sarah", "am_adam", "am_michael", "bf_emma", "bf_isabella", "bm_george", "bm_lewis")


def merged(segments: DataFrame, *keys: str, name: str = "speaker", gender: str = "gender", order: str = "pos") -> DataFrame:
    """One row for each normalised speaker: first spelling, other spellings in order, first known gender.

    Spellings are reduced to one row each before they are gathered, so a hot speaker gathers few rows.
    """
    named = segments.withColumn("key", T.name_key(F.col(name))).where(~F.col("key").isin("", "narrator", "unknown"))
    spelt = named.groupBy(*keys, "key", name).agg(F.min(order).alias("first"), F.min(F.when(F.col(gender).isin("male", "female"), F.struct(order, gender))).alias("known"))
    out = spelt.groupBy(*keys, "key").agg(F.array_sort(F.collect_list(F.struct("first", F.col(name).alias("name")))).alias("all"), F.min("known").alias("known"))
    names = F.transform("all", lambda x: x["name"])
    return out.select(*keys, "key", names[0].alias("name"), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))).alias("aliases"), F.coalesce(F.col(f"known.{gender}"), F.lit("unknown")).alias("gender"), F.col("all")[0]["first"].alias("first"))


def last_of_best(rows: DataFrame, *keys: str, name: str, score: str, order: str) -> DataFrame:
    """For each lower-cased name the row of the highest score, the later of equals; seen is where it first stood."""
    key = F.lower(F.col(name))
    return rows.groupBy(*keys, key.alias("key")).agg(F.max_by(F.struct(*rows.columns), F.struct(score, order)).alias("r"), F.min(order).alias("seen")).select("key", "seen", "r.*")


def first_of_each(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def registry(segments: DataFrame, *keys: str, name: str = "speaker", order: str = "pos") -> DataFrame:
    """Ids char_1, char_2, ... by first appearance within keys; an empty name is unknown and has no number."""
    named = segments.withColumn("key", F.lower(T.strip(F.coalesce(name, F.lit("")))))
    seen = named.where("key <> ''").groupBy(*keys, "key").agg(F.min(F.struct(order, F.col(name).alias("name"))).alias("f"))
    placed = ranks.numbered(seen.select(*keys, "key", F.col(f"f.{order}").alias("__o"), F.col("f.name").alias("__name")), "__o", "key", keys=keys, name="__n")
    return placed.select(*keys, "key", F.concat(F.lit("char_"), F.col("__n").cast("string")).alias("character_id"), T.strip(F.col("__name")).alias("display_name"))


def pronoun_rows(sentences: DataFrame, *keep: str, text: str = "sentence") -> DataFrame:
    """(keep, pronoun, category) for each pronoun token; one token counts once for each of its categories."""
    dim = F.array(*(F.struct(F.lit(p).alias("pronoun"), F.lit(c).alias("category")) for c, ps in PRONOUNS.items() for p in ps))
    tokens = sentences.select(*keep, F.explode(F.split(T.squeeze(F.lower(F.col(text))), " ")).alias("t")).select(*keep, F.regexp_replace("t", r"[^\p{L}\p{N}_]", "").alias("pronoun"))
    every = sorted({p for ps in PRONOUNS.values() for p in ps})
    return tokens.where(F.col("pronoun").isin(*every)).select(*keep, "pronoun", F.explode(F.filter(dim, lambda d: d["pronoun"] == F.col("pronoun"))).alias("d")).select(*keep, "pronoun", "d.category")


def inferred_gender(pronoun: str = "pronoun", n: str | None = None) -> Column:
    """An aggregate: the gender whose pronouns are strictly most; else neutral if any is; else null."""
    weight = F.col(n) if n else F.lit(1)
    total = lambda words: F.coalesce(F.sum(F.when(F.col(pronoun).isin(*words), weight)), F.lit(0))
    m, f, o = total(MALE), total(FEMALE), total(NEUTRAL)
    return F.when((m > f) & (m > o), "male").when((f > m) & (f > o), "female").when(o > 0, "neutral")


def preferred_pronouns(gender: Column) -> Column:
    parts = ("subject", "object", "possessive", "possessive_pronoun", "reflexive")
    out = F.create_map().cast("map<string,string>")
    for g, words in PREFERRED.items():
        out = F.when(gender == g, F.create_map(*(F.lit(x) for pair in zip(parts, words) for x in pair))).otherwise(out)
    return out


def pronoun_rules(current: str, desired: str) -> list[dict]:
    """Rules for text.apply_rules that turn one gender's pronouns into another's."""
    if current == desired or current not in PREFERRED or desired not in PREFERRED:
        return []
    pairs = [(a, b) for i, (a, b) in enumerate(zip(PREFERRED[current], PREFERRED[desired])) if i != 3 and a != b]
    return [{"pattern": rf"\b{a}\b", "replacement": b, "is_regex": True, "enabled": True} for a, b in pairs]


def report(profiles: DataFrame, usage: DataFrame, *keys: str) -> DataFrame:
    """(keys, report): characters by mentions, the most first, each with gender and its pronouns by count; ties by name.

    profiles has (keys, name, mentions, gender), usage (keys, name, pronoun, n).
    """
    line = F.concat(F.lit("    "), "pronoun", F.lit(": "), F.col("n").cast("string"))
    used = usage.groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "pronoun", line.alias("line"))))["line"].alias("lines"))
    rows = profiles.join(used, [*keys, "name"], "left")
    block = F.concat(F.lit("Character: "), "name", F.lit("\n  Mentions: "), F.col("mentions").cast("string"), F.lit("\n  Gender: "), F.coalesce("gender", F.lit("Unknown")), F.when(F.size("lines") > 0, F.concat(F.lit("\n  Pronoun Usage:\n"), F.array_join("lines", "\n"))).otherwise(""))
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("minus"), "name", block.alias("block"))))["block"], "\n\n").alias("report"))


def first_characters(characters: DataFrame, *keys: str, order: str = "pos", most: int = 20) -> DataFrame:
    """(keys, characters, summary): how many there are, and the names of the first ones in order."""
    ranked = characters.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    early = F.when(F.col("__n") <= most, F.struct("__n", "name"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("characters"), F.array_join(F.array_sort(F.collect_list(early))["name"], ", ").alias("summary"))


def back_references(sentences: DataFrame, names: Column, doc: str = "doc_id", order: str = "pos", text: str = "sentence", window: int = 3) -> DataFrame:
    """Adds `mentioned`, the first of names in the sentence, and `referent`: that, or for a sentence with pronouns
    alone the one of the nearest sentence before it within the window."""
    first = F.get(F.filter(names, lambda n: F.contains(F.col(text), n)), F.lit(0))
    every = "|".join(sorted({p for ps in PRONOUNS.values() for p in ps}))
    by = Window.partitionBy(doc).orderBy(order).rowsBetween(-window, -1)
    rows = sentences.withColumn("mentioned", first).withColumn("has_pronoun", F.lower(text).rlike(rf"(^|\s)\W*({every})\W*(\s|$)"))
    return rows.withColumn("referent", F.when(F.col("mentioned").isNotNull(), F.col("mentioned")).when(F.col("has_pronoun"), F.last("mentioned", ignorenulls=True).over(by)))


def resolved(segments: DataFrame, characters: DataFrame, speaker: str = "speaker", fuzzy_cutoff: float | None = 0.85) -> DataFrame:
    """Adds character, voice_of and how (exact, alias, fuzzy or null) by a speaker's normalised name.

    characters has name, aliases, voice and pos, its order. Exact and alias look-ups are joins; what is left over is
    reduced to distinct names and looked up by pieces (fuzzy.closest, which loses nothing).
    """
    keys = first_of_each(characters.select(T.name_key(F.col("name")).alias("k"), F.col("name").alias("character"), F.col("voice").alias("voice_of"), "pos"), "k", order="pos")
    bridge = characters.select(F.explode("aliases").alias("a"), "name", "voice", "pos")
    alias = first_of_each(bridge.select(T.name_key(F.col("a")).alias("k"), F.col("name").alias("a_character"), F.col("voice").alias("a_voice"), "pos"), "k", order="pos")
    rows = segments.withColumn("k", T.name_key(F.coalesce(F.col(speaker), F.lit(""))))
    rows = rows.join(keys.drop("pos"), "k", "left").join(alias.drop("pos"), "k", "left")
    out = rows.withColumn("how", F.when(F.col("character").isNotNull(), "exact").when(F.col("a_character").isNotNull(), "alias"))
    out = out.withColumn("character", F.coalesce("character", "a_character")).withColumn("voice_of", F.coalesce("voice_of", "a_voice")).drop("a_character", "a_voice")
    if fuzzy_cutoff is None:
        return out.drop("k")
    left = out.where("how is null and k <> ''").select("k").distinct()
    near = fuzzy.closest(left, keys.select(F.col("k").alias("c"), F.col("character").alias("f_character"), F.col("voice_of").alias("f_voice")), fuzzy_cutoff)
    out = out.join(near, "k", "left").withColumn("how", F.coalesce("how", F.when(F.col("f_character").isNotNull(), "fuzzy")))
    return out.withColumn("character", F.coalesce("character", "f_character")).withColumn("voice_of", F.coalesce("voice_of", "f_voice")).drop("k", "f_character", "f_voice")


def canonical(segments: DataFrame, characters: DataFrame, speaker: str = "speaker", fuzzy_cutoff: float | None = 0.85) -> DataFrame:
    """Adds canonical_name and canonical_gender: closing signs trimmed, narrator and unknown as they are, else the character
    that the name resolves to, else the trimmed name (unknown if empty) without a gender."""
    bare = F.regexp_replace(T.strip(F.coalesce(F.col(speaker), F.lit(""))), r"(\s*[.,!?;:])+\s*$", "")
    rows = segments.withColumn("__bare", bare)
    out = resolved(rows, characters, "__bare", fuzzy_cutoff).drop("voice_of", "how")
    genders = first_of_each(characters.select(F.col("name").alias("character"), F.col("gender").alias("__g"), "pos"), "character", order="pos").drop("pos")
    out = out.join(genders, "character", "left")
    fixed = F.lower("__bare").isin("narrator", "unknown")
    name = F.when(fixed, F.lower("__bare")).otherwise(F.coalesce("character", F.nullif(F.col("__bare"), F.lit("")), F.lit("unknown")))
    return out.withColumn("canonical_name", name).withColumn("canonical_gender", F.when(~fixed, F.col("__g"))).drop("__bare", "character", "__g")


def route_voice(voice: Column, kind: Column, speaker: Column, gender: Column, character_voice: Column, narrator: str, male: str, female: str) -> Column:
    """The voice of a segment: its own, the narrator's for thoughts and nameless speakers, the character's, its gender's, the narrator's."""
    own, who = F.nullif(T.strip(F.coalesce(voice, F.lit(""))), F.lit("")), T.strip(F.coalesce(speaker, F.lit("")))
    low = F.lower(F.coalesce(gender, F.lit("unknown")))
    by_name = F.when((F.lower(F.coalesce(kind, F.lit("narration"))) == "thought") | (who == "") | F.lower(who).isin("narrator", "unknown"), narrator)
    return F.coalesce(own, by_name, F.nullif(character_voice, F.lit("")), F.when(low == "male", male).when(low == "female", female), F.lit(narrator))


def mapped_voice(segments: DataFrame, mapping: DataFrame, narrator: str, male: str, female: str) -> DataFrame:
    """Adds voice and resolution (exact, normalized, fallback_gender, fallback) by mapping(name, voice); of equal normalised names the last by pos."""
    exact = mapping.select(F.col("name").alias("speaker"), F.col("voice").alias("v1"))
    loose = mapping.groupBy(T.squeezed_key(F.col("name")).alias("k")).agg(F.max_by("voice", "pos").alias("v2"))
    rows = segments.withColumn("k", T.squeezed_key(F.col("speaker"))).join(exact, "speaker", "left").join(loose, "k", "left")
    low = F.lower(F.trim(F.coalesce("gender", F.lit(""))))
    by_gender = F.when(low == "male", male).when(low == "female", female)
    how = F.when(F.col("v1").isNotNull(), "exact").when(F.col("v2").isNotNull(), "normalized").when(by_gender.isNotNull(), "fallback_gender").otherwise("fallback")
    return rows.withColumn("resolution", how).withColumn("voice", F.coalesce("v1", "v2", by_gender, F.lit(narrator))).drop("k", "v1", "v2")


def emotion_modifiers(spark) -> DataFrame:
    return spark.createDataFrame(list(EMOTIONS), "emotion string, speed_multiplier double, pitch_shift double, volume_db double")


def emotion_speed(base: Column, emotion: Column) -> Column:
    factor = F.lit(1.0)
    for name, speed, _, _ in EMOTIONS:
        factor = F.when(F.lower(emotion) == name, speed).otherwise(factor)
    return base * factor


def needs_review(confidence: Column, flag: Column, limit: float = 0.8) -> Column:
    """A missing confidence counts as sure; a flag that is set stays."""
    return F.when(F.coalesce(confidence, F.lit(1.0)) < limit, True).otherwise(F.coalesce(flag, F.lit(False)))


def overridden(segments: DataFrame, overrides: DataFrame, key: str = "segment_id") -> DataFrame:
    """Rows with the override's columns where it has a row for them, nulls included; its new columns are added."""
    marked = overrides.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__o_{c}") for c in overrides.columns if c != key))
    rows = segments.join(marked, F.col(key) == F.col("__k"), "left")
    columns = [F.when(F.col("__hit"), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) if c in overrides.columns and c != key else F.col(c) for c in segments.columns]
    return rows.select(*columns, *(F.col(f"__o_{c}").alias(c) for c in overrides.columns if c not in segments.columns))


def upserted(characters: DataFrame, changes: DataFrame) -> DataFrame:
    """characters and changes have name, gender, voice, aliases, by normalised name: what a change gives wins, aliases join."""
    c = characters.select(T.name_key(F.col("name")).alias("k"), *(F.col(x).alias(f"c_{x}") for x in ("name", "gender", "voice", "aliases")))
    n = changes.select(T.name_key(F.col("name")).alias("k"), *(F.col(x).alias(f"n_{x}") for x in ("name", "gender", "voice", "aliases")))
    none = F.array().cast("array<string>")
    given = lambda x: F.coalesce(F.nullif(F.col(f"n_{x}"), F.lit("")), F.col(f"c_{x}"))
    aliases = F.array_sort(F.array_union(F.coalesce("c_aliases", none), F.coalesce("n_aliases", none)))
    return c.join(n, "k", "full_outer").select(F.coalesce("c_name", "n_name").alias("name"), given("gender").alias("gender"), given("voice").alias("voice"), aliases.alias("aliases"))


def removed(characters: DataFrame, names: DataFrame) -> DataFrame:
    gone = names.select(T.name_key(F.col("name")).alias("__k")).distinct()
    return characters.join(gone, T.name_key(F.col("name")) == F.col("__k"), "left_anti")


def merge_pair(a: Column, b: Column) -> Column:
    """The preview of merging character structs a and b."""
    text = lambda k: F.coalesce(F.nullif(a[k], F.lit("")), b[k]).alias(k)
    none = F.array().cast("array<string>")
    names = F.array_union(F.array_union(F.coalesce(a["aliases"], none), F.coalesce(b["aliases"], none)), F.array(a["name"], b["name"]))
    return F.struct(text("name"), F.when(F.coalesce(a["gender"], F.lit("unknown")) != "unknown", a["gender"]).otherwise(b["gender"]).alias("gender"), text("voice"), F.array_sort(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")).alias("aliases"), text("description"))


def merged_into(characters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Characters after merges of pairs (primary, secondary), each name in one pair: aliases and the secondary's name join the
    primary, which takes the secondary's voice if it has none, and the secondary goes. Pairs of unknown or equal names change nothing."""
    keyed = characters.withColumn("__k", T.name_key(F.col("name")))
    both = pairs.select(T.name_key(F.col("primary")).alias("__p"), T.name_key(F.col("secondary")).alias("__s")).where("__p <> __s")
    known = keyed.select("__k")
    both = both.join(known.select(F.col("__k").alias("__p")), "__p", "left_semi").join(keyed.select(F.col("__k").alias("__s"), F.col("name").alias("__name"), F.col("voice").alias("__voice"), F.col("aliases").alias("__aliases")), "__s")
    rows = keyed.join(both.select(F.col("__s").alias("__k")), "__k", "left_anti").join(both.withColumnRenamed("__p", "__k").drop("__s"), "__k", "left")
    none = F.array().cast("array<string>")
    whole = F.array_sort(F.array_union(F.array_union(F.coalesce("aliases", none), F.coalesce("__aliases", none)), F.array("__name")))
    hit = F.col("__name").isNotNull()
    return rows.withColumn("aliases", F.when(hit, whole).otherwise(F.col("aliases"))).withColumn("voice", F.when(hit, F.coalesce(F.nullif("voice", F.lit("")), "__voice", "voice")).otherwise(F.col("voice"))).select(*characters.columns)


def tidy_aliases(aliases: Column) -> Column:
    return F.array_sort(T.nonblank(aliases))


def search(characters: DataFrame, words: str) -> DataFrame:
    whole = F.lower(F.concat_ws(" ", F.col("name"), F.array_join("aliases", " ")))
    return characters.where(F.contains(whole, F.lit(words.lower())))


def context_lines(characters: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """One text of known characters for a prompt, a line each, in order."""
    line = F.concat(F.col("name"), F.lit(" | aliases="), F.coalesce(F.nullif(F.array_join("aliases", ", "), F.lit("")), F.lit("-")), F.lit(" | gender="), F.coalesce("gender", F.lit("unknown")), F.lit(" | description="), F.coalesce("description", F.lit("")))
    return characters.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def first_set(*values: Column) -> Column:
    """The first value that is not null: settings by precedence."""
    return reduce(lambda a, b: F.coalesce(a, b), values)
