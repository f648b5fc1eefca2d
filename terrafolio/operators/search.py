"""Address search: an index of pieces of words and whole words, from which each request reads the postings of its rarest word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.functions.text import search_text
from terrafolio.operators.order import kept, settled

# fixed values: how the city abbreviates words of streets' names, and words that a request needn't have
ABBREVIATIONS = {
    "ALAMEDA": ("AL",), "ALMIRANTE": ("ALM",), "AVENIDA": ("AV", "AVD"), "BARAO": ("BR",), "BRIGADEIRO": ("BRIG",), "CAPITAO": ("CAP",), "COMENDADOR": ("COMEN",), "CONDE": ("CD",), "CONSELHEIRO": ("CONS",),
    "CORONEL": ("CEL",), "DEPUTADO": ("DEP",), "DOUTOR": ("DR",), "DOUTORA": ("DRA",), "ENGENHEIRO": ("ENG",), "GENERAL": ("GAL",), "MAJOR": ("MAJ",), "MARECHAL": ("MAL",), "MARQUES": ("MARQ",), "MINISTRO": ("MIN",),
    "NOSSA": ("NSA", "NSRA"), "PADRE": ("PDE", "PE"), "PRACA": ("PC",), "PROFESSOR": ("PROF",), "PROFESSORA": ("PROFA",), "RUA": ("R",), "SANTA": ("STA",), "SANTO": ("STO",), "SAO": ("S",), "SENADOR": ("SEN",),
    "TENENTE": ("TTE",), "TRAVESSA": ("TV",), "VEREADOR": ("VER",), "VISCONDE": ("VISC",),
}
NO_WORTH = ("DA", "DAS", "DE", "DO", "DOS", "E", "SENHORA")
#: Letters of the longest pieces that the index holds.
GRAM = 3


def _pieces(text: Column, n: int) -> Column:
    """All stretches of ``n`` letters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def posted(places: DataFrame) -> DataFrame:
    """token, id: the index of ``places`` (id, texto): every piece of up to three letters, and ``=`` before each whole word.

    To be written once and read by every search. Null texts have no tokens.
    """
    texts = places.select("id", search_text(F.col("texto")).alias("t")).where("t <> ''")
    grams = F.flatten(F.array(*(_pieces(F.col("t"), n) for n in range(1, GRAM + 1))))
    words = F.transform(F.split("t", " "), lambda w: F.concat(F.lit("="), w))
    return texts.select(F.explode(F.array_distinct(F.concat(grams, words))).alias("token"), "id")


def texts(places: DataFrame) -> DataFrame:
    """texto, id: each text of ``places`` once, under its least id. All that an index needs, where many places share a text."""
    return places.groupBy("texto").agg(F.min("id").alias("id"))


def _other_words(word: Column) -> Column:
    table = F.create_map(*(x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*(F.lit(a) for a in v)))))
    return F.coalesce(F.try_element_at(table, word), F.array().cast("array<string>"))


def understood(requests: DataFrame) -> DataFrame:
    """req, nomes (words to find), numero (the last number, without zeros before it) of requests (req, pedido) that have a word to find."""
    number = lambda w: w.rlike("^[0-9]+$")
    words = requests.select("req", F.split(search_text(F.col("pedido")), " ").alias("w"))
    names = F.filter("w", lambda w: (w != "") & ~number(w) & ~w.isin(*NO_WORTH))
    last = F.try_element_at(F.filter("w", number), F.lit(-1))
    return words.select("req", F.array_distinct(names).alias("nomes"), F.regexp_replace(last, "^0+(?=[0-9])", "").alias("numero")).where(F.size("nomes") > 0)


def matches(asked: DataFrame, places: DataFrame, postings: DataFrame) -> DataFrame:
    """req and all columns of ``places`` (id, texto, ..) where every word of ``nomes`` is in the text, as a piece of a word too, or its
    abbreviation is as a whole word.

    Of each request the word whose postings are fewest is looked up, by its rarest piece and its abbreviations; what is found
    there is then held against all words. A piece that no place has finds nothing, without a look at any place.
    """
    options = asked.select("req", F.explode("nomes").alias("nome"))
    whole = F.transform(_pieces(F.col("nome"), GRAM), lambda g: g)
    grams = F.when(F.length("nome") >= GRAM, whole).otherwise(F.array("nome"))
    tokens = options.select("req", "nome", F.explode(grams).alias("token"), F.lit(True).alias("piece")).union(options.select("req", "nome", F.explode(F.transform(_other_words(F.col("nome")), lambda a: F.concat(F.lit("="), a))).alias("token"), F.lit(False).alias("piece")))
    sizes = postings.join(tokens.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("k"))
    costed = tokens.join(sizes, "token", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    pieces = costed.where("piece").groupBy("req", "nome").agg(F.min_by("token", F.struct("k", "token")).alias("token"), F.min("k").alias("k"))
    looked = pieces.union(costed.where("not piece").select("req", "nome", "token", "k"))
    cost = looked.groupBy("req", "nome").agg(F.sum("k").alias("k"), F.collect_set("token").alias("tokens"))
    rarest = cost.groupBy("req").agg(F.min_by("tokens", F.struct("k", "nome")).alias("tokens"))
    found = rarest.select("req", F.explode("tokens").alias("token")).join(postings, "token").select("req", "id").distinct()
    text = search_text(F.col("texto"))
    fits = F.forall("nomes", lambda n: F.contains(F.col("_texto"), n) | F.arrays_overlap(F.split("_texto", " "), _other_words(n)))
    both = found.join(asked.select("req", "nomes", F.col("numero").alias("_numero")), "req").join(places.withColumn("_texto", text), "id")
    return both.where(fits).select("req", "_numero", *places.columns)


def suggestions(requests: DataFrame, buildings: DataFrame, streets: DataFrame, building_postings: DataFrame, street_postings: DataFrame, top: int = 8, most_streets: int = 12) -> DataFrame:
    """req, posto, tipo (predio or rua), id, rotulo: what is suggested for each request, ``top`` at most.

    ``buildings`` has id, texto, numero, rotulo, ``streets`` id, texto, nome, lugar; postings are those of all of them, or of the ``texts`` of
    buildings. With a number only buildings of that number fit, in the order of ids; without one the first by id are shown by their label.
    Where no building has the number, the streets that fit are offered with it, each label once a place.
    """
    # requests with the same words are searched once, and so are places with the same text, which are then told apart by number; rows are
    # dealt out first, since a small file may hold many
    asked = understood(requests.repartition("req"))
    names = settled(asked.select("nomes").distinct().withColumn("words", F.monotonically_increasing_id()))
    asked = settled(asked.join(names, "nomes").select("req", "words", "numero"))
    searched = names.select(F.col("words").alias("req"), "nomes", F.lit(None).cast("string").alias("numero"))
    kinds = kept(asked.select("words", F.col("numero").alias("_numero")).distinct())
    # of the places with one text and number only the first by id can be shown
    least = lambda keys, rows: rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("k") <= top).drop("k")
    houses = kept(least(["texto", "numero"], buildings.select("texto", "numero", "id", "rotulo")))
    fits = kept(matches(searched, settled(texts(buildings)), building_postings).select(F.col("req").alias("words"), "texto"))
    of_number = houses.join(kinds.select(F.col("_numero").alias("numero")).distinct(), "numero", "left_semi")
    numbered = fits.join(of_number, "texto").withColumnRenamed("numero", "_numero").join(kinds, ["words", "_numero"])
    fits = fits.join(kinds.where("_numero is null"), "words").join(least(["texto"], houses.drop("numero")), "texto")
    fits = fits.select("words", "_numero", "id", "rotulo").unionByName(numbered.select("words", "_numero", "id", "rotulo"))
    first = kept(least(["words", "_numero"], fits))
    by_label = F.row_number().over(Window.partitionBy("words", "_numero").orderBy(F.when(F.col("_numero").isNull(), F.col("rotulo")), "id"))
    shown = first.select("words", "_numero", by_label.alias("posto"), F.lit("predio").alias("tipo"), "id", "rotulo")
    left = kept(kinds.where("_numero is not null").join(first.select("words", "_numero"), ["words", "_numero"], "left_anti"))
    roads = matches(searched.join(left.select(F.col("words").alias("req")).distinct(), "req"), streets, street_postings).drop("_numero").withColumnRenamed("req", "words")
    roads = roads.withColumn("k", F.row_number().over(Window.partitionBy("words").orderBy("id"))).where(F.col("k") <= most_streets).join(left, "words")
    named = roads.groupBy("words", "_numero", F.concat_ws(", ", "nome", "_numero").alias("rotulo"), "lugar").agg(F.min("id").alias("id"))
    place = F.row_number().over(Window.partitionBy("words", "_numero").orderBy("id"))
    offered = named.select("words", "_numero", place.alias("posto"), F.lit("rua").alias("tipo"), "id", "rotulo").where(F.col("posto") <= top)
    every = kept(shown.union(offered).withColumnRenamed("words", "_words"))
    return asked.join(every, (F.col("words") == F.col("_words")) & F.col("numero").eqNullSafe(F.col("_numero"))).select("req", "posto", "tipo", "id", "rotulo")
