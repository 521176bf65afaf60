"""URL filter (operator 4), DataFrame functions only.

Stated rules decide first (the longest that fits wins); every other url is judged
by a logistic regression on hashed character n-grams of host and path.  The model
is trained from a small labelled url table, whole in one SQL expression: forward
lists (features of each example) give the errors, posting lists (examples of each
feature) give the gradient, and ``aggregate`` runs the epochs.

Defined results: a null url, or one without ``://``, has empty host and path and
is judged by the few n-grams of the empty marks and the bias; a score of exactly zero
allows; among rules of one length the first listed wins; urls are read whole, however
long; repeated rows are judged one by one; an empty table gives an empty result.
Columns of the input named host, path, rule, verdict or score are replaced, all others
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: the contract's rules
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: the labelled table's hosts, written down from general knowledge of the web; fixed values
BAD = (
    "onlinecasino casinobonus slotmachines jackpotcity pokerroom roulettespin betting247 sportsbet lotterywinner bingohall buyviagra cialisonline discountmeds rxpharmacy painpills dietpills steroidshop xxxtube pornstars adultdating sexcams nudegirls escortservice hotwives "
    "paydayloan quickcash debtrelief bitcoinprofit cryptodoubler forexsignals getrichnow replicawatches fakerolex luxuryhandbags warezcentral crackedgames keygenerator torrentking freemovies adserver adtracker popupads bannerclicks trafficexchange spammail linkfarm backlinks "
    "buyfollowers miracleweightloss psychicreadings winprizes freegiftcard surveyrewards freeiphone"
).split()
#: common words of such hosts, each written with two of the affixes in turn; fixed values
ROOTS = "casino poker slots roulette jackpot bet betting lottery bingo viagra pills meds pharmacy steroids porn xxx sex adult cams dating escort loans payday cash bitcoin crypto forex replica warez crack keygen torrent ads ad popup clicks traffic spam links followers prizes".split()
AFFIXES = ("online{}", "{}24", "best{}", "{}hub", "top-{}", "{}-deals", "{}zone", "e{}s", "my{}", "{}-club")
GOOD = (
    "dailynews cityguardian publiclibrary stateuniversity sciencemuseum weatherservice gardenclub cookbook travelguide healthinfo musicschool historyarchive worldatlas filmreview poetrycorner mathforum bikeshop bookstore artgallery communitycentre parliament chessclub birdwatching photography software developers opensource gazette observer tribune theatre orchestra football swimming farmers bakery "
    "zeitung stadtbibliothek hochschule gesundheit reisen rezepte wetterdienst geschichte wissenschaft handwerk nachrichten verein journal bibliotheque recettes voyages musee meteo sante ecole cinema jardinage quotidien universite noticias biblioteca universidad cocina viajes museo tiempo salud escuela jardin periodico ciencia "
    "archive docs wiki blog shop status mail forum help about people stories letters notes almanac railway harbour mountain rivers island meadow orchard village castle northern western eastern southern"
).split()
LEADS = ("", "www.", "en.", "my")
ENDS = (".com/", ".net/index.html", ".info/page/{}", ".co/article-{}", ".eu/start?id={}")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled url table: (url, 1 for block).

    Every host is written twice, with leads and ends dealt in turn over both labels, so
    that only the host itself tells them apart.
    """
    built = [AFFIXES[(3 * i + k) % len(AFFIXES)].format(root) for i, root in enumerate(ROOTS) for k in range(2)]
    hosts = [(w, 1) for w in [*BAD, *built]] + [(w, 0) for w in GOOD]
    return [(f"http://{LEADS[(i + k) % 4]}{w}{ENDS[(i + 2 * k) % 5].format(17 + 31 * i)}", y) for i, (w, y) in enumerate(hosts) for k in range(2)]


DIM = 4096
GRAMS = (3, 4)
EPOCHS, RATE, DECAY = 120, 1.0, 0.0005


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def features(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of the marked host and of the marked path, 0 <= f < DIM."""

    def grams(text: Column, salt: int) -> Column:
        def of_length(t: Column, n: int) -> Column:
            gram = lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substr(t, i, F.lit(n))), F.lit(DIM)).cast("int")
            return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), gram)).otherwise(F.array().cast("array<int>"))

        def of(t: Column) -> Column:
            return F.concat(*[of_length(t, n) for n in GRAMS])

        return _let(text, of)

    return F.array_distinct(F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), 1), grams(F.concat(F.lit("^"), path), 2)))


def train(spark: SparkSession, labelled=None) -> DataFrame:
    """One row with ``w``: the bias at 0 and DIM weights after it.

    ``labelled`` is a small table of (url, 0 or 1) pairs; its size is the caller's
    parameter and does not follow the corpus.
    """
    labelled = labelled_urls() if labelled is None else labelled
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, y double")
    host, path = parts(F.col("url"))
    rows = rows.select("i", "y", features(host, path).alias("x"))
    posts = rows.select("i", F.explode("x").alias("f")).groupBy("f").agg(F.sort_array(F.collect_list("i")).alias("p"))
    examples = rows.agg(F.array_sort(F.collect_list(F.struct("i", "y", "x"))).alias("examples"))
    lists = posts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "p")))).alias("posts"))
    one = examples.select("examples", lists.scalar().alias("posts"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: F.coalesce(F.try_element_at("posts", d), F.array().cast("array<int>")))
    one = one.select("examples", dense.alias("dense")).checkpoint()
    n = float(len(labelled))

    def epoch(w: Column, _: Column) -> Column:
        def error(e: Column) -> Column:
            z = F.aggregate(e["x"], w[0], lambda s, f: s + w[f + 1])
            return e["y"] - 1 / (1 + F.exp(-z))

        def moved(errors: Column) -> Column:
            bias = w[0] + RATE * F.aggregate(errors, F.lit(0.0), lambda s, e: s + e) / n
            rest = F.transform("dense", lambda p, d: w[d + 1] * (1 - DECAY) + RATE * F.aggregate(p, F.lit(0.0), lambda s, i: s + errors[i]) / n)
            return F.concat(F.array(bias), rest)

        return _let(F.transform("examples", error), moved)

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), F.array_repeat(F.lit(0.0), DIM + 1), epoch).alias("w")).checkpoint()


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    if not rules:
        return name, verdict
    name = verdict = None
    for rule, says in sorted(rules, key=lambda r: -len(r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return name, verdict


def weights(model: DataFrame) -> Column:
    """The trained weights as one constant; DIM + 1 numbers, whatever the corpus."""
    return F.split(F.lit(",".join(map(repr, model.first()["w"]))), ",").cast("array<double>")


def judge(pages: DataFrame, model: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict and score (the model's log-odds of block)."""
    host, path = parts(F.col(url))
    mine = ("host", "path", "rule", "verdict", "score")
    out = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in mine], host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    w = weights(model)
    score = F.aggregate(features(F.col("host"), F.col("path")), w[0], lambda s, f: s + w[f + 1])
    out = out.withColumns({"rule": rule, "score": score})
    return out.withColumn("verdict", F.coalesce(says, F.when(F.col("score") > 0, "block").otherwise("allow")))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
