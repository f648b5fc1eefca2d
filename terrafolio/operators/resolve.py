"""Messy place names resolved by prioritised joins and majority votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.functions.stats import majority
from terrafolio.params import DEFAULT, Params


def block_votes(rows: DataFrame, block: str, vote: str, p: Params = DEFAULT) -> DataFrame:
    """block, winner, confianca (%), n, nivel: each block's majority and how sure it is."""
    share = 100 * F.col("votes") / F.col("n")
    level = F.when(share >= p.block_high, "alta").when(share >= p.block_medium, "media").otherwise("baixa")
    return majority(rows, [block], vote).select(block, "winner", share.alias("confianca"), "n", level.alias("nivel"))


def cascade(rows: DataFrame, names: DataFrame, by_address: DataFrame, by_block: DataFrame, by_postcode: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``rows`` with ``destino`` and ``metodo``, by the first method that resolves a row.

    The row's own name, its address's vote, its block's vote if sure, its postcode's vote, its block's vote if fairly sure. The
    dimension of names is small and left to the optimizer to broadcast; votes are joined by key.

    ``rows`` has nome, endereco, quadra, cep; the votes have their key and ``winner``, the blocks' also ``confianca``.
    """
    joined = (
        rows.join(names.select("nome", F.col("destino").alias("_own")), "nome", "left")
        .join(by_address.select("endereco", F.col("winner").alias("_address")), "endereco", "left")
        .join(by_block.select("quadra", F.col("winner").alias("_block"), F.col("confianca").alias("_sure")), "quadra", "left")
        .join(by_postcode.select("cep", F.col("winner").alias("_post")), "cep", "left")
    )
    high = F.when(F.col("_sure") >= p.block_high, F.col("_block"))
    medium = F.when(F.col("_sure") >= p.block_medium, F.col("_block"))
    steps = [("campo_original", F.col("_own")), ("voto_endereco", F.col("_address")), ("quadra_alta", high), ("cep", F.col("_post")), ("quadra_media", medium)]
    method = F.when(F.lit(False), "")
    for name, found in steps:
        method = method.when(found.isNotNull(), name)
    return joined.select(*rows.columns, F.coalesce(*(f for _, f in steps)).alias("destino"), method.otherwise("incerto").alias("metodo"))


def closing_balance(resolved: DataFrame) -> DataFrame:
    """metodo, n, pct: how many rows each method resolved."""
    total = resolved.agg(F.count("*")).scalar()
    return resolved.groupBy("metodo").agg(F.count("*").alias("n")).withColumn("pct", F.floor(F.col("n") * 1000 / total + 0.5) / 10)


# fixed values: statuses of the dictionary of names, spellings of the place that postcodes split, and the number that stands for none
INSIDE, OUTSIDE = ("AUTO_CARTEIRA", "NOVO_BAIRRO"), ("SUGERIDO_FORA", "PADRAO_FORA")
SPLIT_NAMES = ("SANTO AMARO", "STO AMARO", "STO. AMARO")
NO_NUMBER = "99999"


def translated(rows: DataFrame, dictionary: DataFrame, split: DataFrame) -> DataFrame:
    """``rows`` with ``proprio`` and ``status``: what the dictionary (nome, destino, status) makes of ``nome``.

    The place whose name covers several is told apart by the postcode's first five digits in ``split`` (prefixo, destino); prefixes
    that aren't there, or lead to FORA, are outside.
    """
    key = F.upper(F.trim("nome"))
    words = dictionary.select(F.upper(F.trim("nome")).alias("_k"), F.col("destino").alias("_to"), F.col("status").alias("_status"))
    parts = split.select(F.col("prefixo").alias("_p"), F.col("destino").alias("_part"))
    both = rows.withColumns({"_k": key, "_p": F.substring("cep", 1, 5)}).join(words, "_k", "left").join(parts, "_p", "left")
    several = F.coalesce(F.col("_k").isin(*SPLIT_NAMES), F.lit(False))
    outside = F.coalesce("_part", F.lit("FORA")) == "FORA"
    to = F.when(several, F.when(~outside, F.col("_part"))).otherwise(F.col("_to"))
    status = F.when(several, F.when(outside, "SUGERIDO_FORA").otherwise("NOVO_BAIRRO")).otherwise(F.col("_status"))
    return both.select(*rows.columns, F.when(status.isin(*INSIDE), to).alias("proprio"), status.alias("status"))


def resolve_places(rows: DataFrame, voters: DataFrame, blocks: DataFrame, targets: DataFrame, order: list[str], p: Params = DEFAULT) -> DataFrame:
    """``rows`` with ``destino`` and ``metodo``: the own name; its address's vote, unless the number stands for none; its block's, if
    sure; its postcode's; its block's, if fairly sure. Else ``fora_carteira`` if the name or the block is known for another place,
    or ``incerto``.

    All are ``translated`` (nome, endereco, numero, cep, quadra); ``voters`` vote by address and postcode, ``blocks`` by block; of
    equal votes the first met in ``order`` counts, and only places of ``targets`` (destino).
    """
    from terrafolio.functions.text import looks_like_place

    vote = lambda some, key: majority(some.where(F.col("proprio").isNotNull() & F.col(key).isNotNull()), [key], "proprio", order)
    known = targets.select(F.col("destino").alias("winner"))
    votes = lambda key, name: vote(voters, key).join(known, "winner", "left_semi").select(key, F.col("winner").alias(name))
    block = vote(blocks, "quadra").select("quadra", F.col("winner").alias("_block"), (F.floor(1000 * F.col("votes") / F.col("n") + 0.5) / 10).alias("_sure"))
    named = blocks.where(looks_like_place(F.col("nome")) & F.col("quadra").isNotNull()).select("quadra").distinct().withColumn("_any", F.lit(True))
    both = rows.join(votes("endereco", "_address"), "endereco", "left").join(block, "quadra", "left").join(votes("cep", "_post"), "cep", "left").join(named, "quadra", "left")
    address = F.when(~F.col("numero").eqNullSafe(NO_NUMBER), F.col("_address"))
    steps = [("voto_endereco", address), ("quadra_alta", F.when(F.col("_sure") >= p.block_high, F.col("_block"))), ("cep", F.col("_post")), ("quadra_media", F.when(F.col("_sure") >= p.block_medium, F.col("_block")))]
    own, away = F.col("proprio").isNotNull(), F.coalesce(F.col("status").isin(*OUTSIDE), F.lit(False))
    method, to = F.when(own, "campo_original").when(away, "fora_carteira"), F.when(own, F.col("proprio")).when(away, None)
    for name, found in steps:
        method, to = method.when(found.isNotNull(), name), to.when(found.isNotNull(), found)
    elsewhere = looks_like_place(F.col("nome")) | F.coalesce("_any", F.lit(False))
    return both.select(*rows.columns, to.alias("destino"), method.when(elsewhere, "fora_carteira").otherwise("incerto").alias("metodo"))


def portfolio(resolved: DataFrame, units: DataFrame) -> DataFrame:
    """bairro, revenda_12m, planta_12m, unidades, giro (resales per 100 units): ``resolved`` has destino, revenda, planta (12 months)."""
    count = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    sold = resolved.where("destino is not null").groupBy(F.col("destino").alias("bairro")).agg(count("revenda").alias("revenda_12m"), count("planta").alias("planta_12m"))
    every = sold.join(units.groupBy("bairro").agg(F.count("*").alias("unidades")), "bairro", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    turnover = F.floor(F.try_divide(100 * F.coalesce("revenda_12m", F.lit(0)), F.col("unidades")) * 100 + 0.5) / 100
    return every.select("bairro", zero("revenda_12m"), zero("planta_12m"), zero("unidades"), turnover.alias("giro"))


def prefix_majority(rows: DataFrame, key: str, vote: str, order: list[str], least: int = 3, share: float = 0.6) -> DataFrame:
    """key, n, destino: the vote of a share of a key's rows or more, with ``least`` rows at least; unknown votes count as rows, and
    where they are the most there is none."""
    counts = majority(rows.withColumn("_v", F.coalesce(vote, F.lit(""))), [key], "_v", order)
    sure = (F.col("n") >= least) & (F.col("winner") != "") & (F.col("votes") >= share * F.col("n"))
    return counts.select(key, "n", F.when(sure, F.col("winner")).alias("destino"))


def resale_drops(before: DataFrame, after: DataFrame, least: float = 0.25) -> DataFrame:
    """bairro, antes, agora, iguais, mudaram, then where the others went, of places that lost a share of their resales.

    ``before`` and ``after`` have id, destino, classe; classes other than ``revenda`` and ids that are no more are where they went.
    """
    old = before.where("classe = 'revenda' and destino is not null").select("id", F.col("destino").alias("bairro"))
    new = after.select("id", F.col("destino").alias("novo"), F.col("classe").alias("nova"))
    both = old.join(new, "id", "left")
    count = lambda when: F.sum(F.when(when, 1).otherwise(0))
    resale = F.col("nova") == "revenda"
    here = F.col("novo").eqNullSafe(F.col("bairro"))
    gone = both.groupBy("bairro").agg(F.count("*").alias("antes"), count(resale & here).alias("iguais"), count(resale & ~here).alias("mudaram"), *(count(F.col("nova") == c).alias(f"saiu_{c}") for c in ("planta", "parcial", "demais")), count(F.col("nova").isNull()).alias("fora"))
    now = after.where("classe = 'revenda' and destino is not null").groupBy(F.col("destino").alias("bairro")).agg(F.count("*").alias("agora"))
    out = gone.join(now, "bairro", "left").withColumn("agora", F.coalesce("agora", F.lit(0)))
    return out.where((F.col("antes") - F.col("agora")) / F.col("antes") >= least)


def old_rule(sales: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """endereco, classe: planta if any five of an address's valid sales fall within half a year, else revenda; by the old rule, a sale is
    valid if it is a whole market sale of a home. ``sales`` has endereco, dia, valida."""
    from terrafolio.operators.period import launches

    flagged = launches(sales.where("valida and endereco is not null"), "endereco", p=p)
    every = sales.where("endereco is not null").select("endereco").distinct()
    return every.join(flagged, "endereco", "left").select("endereco", F.when(F.coalesce("lancamento", F.lit(False)), "planta").otherwise("revenda").alias("classe"))
