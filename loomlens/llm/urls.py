"""URL filter: allow/block rules, then logistic regression on hashed character
n-grams of host and path. DataFrame and SQL functions only.

Rules are few (they become one CASE expression, longest rule first). For urls that
no rule fits, a model trained from a small labelled url table decides.

Defined cases: a null url or one without "://" has empty host and path, fits no
rule and is allowed (there is nothing to judge); repeated rows are each judged; an
empty table gives an empty result; null ids are kept; other columns are not read.

Plan: a narrow scan of two columns; no exchange at all.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 13
SIZES = (3, 4, 5)
THRESHOLD = 0.55  # chance of block from which a url is blocked: a wrong block costs more than a wrong allow
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled url table, invented for this purpose.
BLOCK_URLS = """
royal-casino-online.com/slots/jackpot.html www.luckycasino77.com/bonus/free-spins.html poker-champ.net/play/texas-holdem.html
blog.vegas-slots4u.net/slots/big-win.html m.megajackpot-games.org/casino/roulette.html sportbetting-tips.org/odds/today.html
betmaster24.com/bets/live-odds.html www.bestodds-bookmaker.com/betting/bonus.html bingo-jackpot.net/play/bonus.html
blog.lottowinners-club.net/claim/prize.html m.online-gambling-guide.org/casino/bonus-code.html roulette-tricks.org/win/money.html
generic-meds-rx.com/pills/buy-now.html www.weightloss-pillshop.com/diet-pills/order.html rx-pharmacy-direct.net/viagra/cheap.html
blog.cialis-discounts.net/buy/pills.html m.no-prescription-drugs.org/pharmacy/order-now.html herbal-enlargement.org/pills/offer.html
steroids-bulk.com/shop/cheap-steroids.html www.slimming-miracle.com/offer/lose-weight-fast.html
hotadultvideos.net/xxx/videos.html blog.xxx-live-cams.net/adult/girls.html m.porn-movies-tube.org/sex/free.html
adultdating-now.org/sex/dating.html sexy-webcam-chat.com/cams/live-girls.html www.escorts-city.com/adult/escort.html
nude-pics-gallery.net/xxx/pics.html blog.erotic-tube-free.net/porn/videos.html m.milf-hookup.org/adult/meet.html
adserver-network.org/ads/banner.js banner-ads-rotator.com/adclick/redirect.php www.pixel-tracking-cdn.com/track/pixel.gif
click-tracker99.net/click/redirect.php blog.popads-delivery.net/ads/popunder.js m.adtraffic-exchange.org/adserver/impression.php
affiliate-clicks.org/track/aff.php retarget-beacon.com/tracking/beacon.gif www.doubleads-media.com/ads/serve.js
spam-blaster.net/spam/mailing.html blog.bulk-email-spammer.net/spam/list.html m.linkfarm-directory.org/links/exchange.html
seo-backlinks-cheap.org/links/buy.html free-traffic-bot.com/spam/bot.html www.article-spinner-spam.com/spin/content.html
warez-downloads.net/crack/serial.html blog.keygen-cracks.net/download/keygen.exe m.serialz-crackz.org/crack/full.exe
torrent-pirate-movies.org/download/free-full-movie.html free-cracked-games.com/download/crack.exe www.nulled-scripts.com/download/nulled.zip
paypal-account-verify.net/login/verify.php blog.secure-bank-login.net/signin/confirm.php m.appleid-unlock-support.org/login/verify-account.php
update-your-password.org/signin/password.php account-suspended-alert.com/verify/login.php www.wallet-recovery-phrase.com/claim/verify.php
free-iphone-giveaway.net/claim/prize.html blog.you-won-giftcard.net/prize/claim-now.html m.survey-rewards4u.org/win/gift.html
get-rich-quick-system.org/make-money/fast.html work-from-home-cash.com/make-money/easy.html www.bitcoin-doubler-pro.com/crypto/double.html
forex-robot-profit.net/make-money/robot.html blog.payday-cash-loans.net/loans/instant.html m.quick-loan-approval.org/loan/apply-now.html
badcredit-loans-fast.org/loans/approved.html debt-consolidate-now.com/loan/offer.html www.replica-rolex-watches.com/shop/replica.html
fake-designer-bags.net/replica/cheap.html blog.cheap-nike-outlet.net/shop/discount.html m.ugg-boots-sale.org/cheap/outlet.html
malware-free-download.org/download/setup.exe pc-speedup-cleaner.com/download/cleaner.exe www.codec-pack-installer.com/download/player.exe
psychic-love-spells.net/offer/spells.html blog.hair-regrowth-miracle.net/offer/order-now.html m.cheapcigarettes-online.org/shop/cheap.html
"""
ALLOW_URLS = """
morning-herald.com/news/2019/05/budget-vote.html www.riverside-gazette.com/local/council-meeting.html national-post-review.net/politics/election-report.html
blog.evening-standard-times.net/sport/football-results.html m.worldwire-press.org/world/climate-summit.html businessledger.org/markets/quarterly-earnings.html
openencyclopedia.com/wiki/Photosynthesis www.historypedia.com/wiki/Roman_Empire sciencepedia.net/wiki/Quantum_mechanics
blog.literature-archive.net/books/chapter-3.html m.classic-texts-library.org/poetry/index.html public-domain-books.org/authors/tolstoy.html
stateuniversity.com/courses/linear-algebra.html www.technical-institute.com/research/papers.html open-lectures.net/physics/lecture-12.html
blog.mathworld-notes.net/topology/compactness.html m.algorithms-handbook.org/sorting/quicksort.html statistics-primer.org/regression/least-squares.html
python-tutorials.com/docs/getting-started.html www.webdev-reference.com/docs/html/forms.html database-manual.net/docs/sql/joins.html
blog.linux-admin-guide.net/howto/backup.html m.compiler-design.org/articles/parsing.html opensource-projects.org/releases/changelog.html
gardeners-almanac.com/plants/tomatoes.html www.home-cooking-recipes.com/recipes/apple-pie.html bread-and-butter-kitchen.net/recipes/sourdough.html
blog.mountain-hiking-trails.net/trails/alpine-route.html m.travel-journal-asia.org/japan/kyoto-temples.html island-ferry-timetable.org/schedule/summer.html
city-museum.com/exhibitions/impressionists.html www.symphony-orchestra.com/concerts/season.html folk-music-archive.net/songs/ballads.html
blog.childrens-hospital.net/patients/visiting-hours.html m.family-health-advice.org/conditions/asthma.html nutrition-science.org/articles/vitamins.html
weather-station.com/forecast/weekly.html www.astronomy-observatory.com/planets/saturn.html geology-society.net/rocks/granite.html
blog.birdwatching-club.net/species/kingfisher.html m.marine-biology.org/species/dolphins.html forest-conservation.org/projects/replanting.html
parliament-records.com/debates/session-14.html www.county-council.com/services/libraries.html supreme-court-reports.net/cases/opinion.html
blog.chess-federation.net/tournaments/results.html m.cycling-touring.org/routes/danube.html rowing-club.org/events/regatta.html
woodworking-plans.com/projects/bookshelf.html www.knitting-patterns.com/patterns/scarf.html vintage-radio-repair.net/guides/receiver.html
blog.parenting-today.net/articles/sleep-routine.html m.language-learning.org/lessons/french-verbs.html teachers-resource.org/lessons/fractions.html
genealogy-records.com/parish/register.html www.architecture-review.com/buildings/cathedral.html railway-history.net/lines/northern.html
blog.camera-lens-review.net/reviews/telephoto.html m.film-critics-circle.org/reviews/documentary.html theatre-listings.org/shows/hamlet.html
economics-journal.com/papers/inflation.html www.philosophy-forum.com/topics/ethics.html psychology-notes.net/memory/attention.html
blog.garden-bees.net/en/hives/12.html m.stadtbibliothek-nord.org/de/katalog/33.html musee-des-arts.org/fr/collections/8.html
biblioteca-central.com/es/libros/41.html www.bergwandern-verein.com/de/touren/7.html cuisine-familiale.net/fr/recettes/55.html
blog.agriculture-weekly.net/crops/wheat.html m.fisheries-report.org/reports/2021.html energy-policy.org/wind/turbines.html
veterinary-clinic.com/animals/horses.html www.volunteer-network.com/about/contact.html community-radio.net/programs/morning.html
blog.amateur-telescope.net/index.html m.village-church.org/index.html small-press-magazine.org/index.html
maps-and-surveys.com/ www.charity-runners.com/ local-history-walks.net/ blog.botanical-garden.net/ m.harbour-pilots.org/
"""


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def fits(rule: str, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, with a path that starts as the rule's."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def rule_of(rules: dict[str, str], host: Column, path: Column) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        out = F.when(fits(rule, host, path), F.lit(rule)).otherwise(out)
    return out


def runs(text: Column, n: int, mark: str) -> Column:
    """All runs of n characters (the text itself if it is shorter), marked."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(text, i, F.lit(n))))


def grams(text: Column, mark: str) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    return F.concat(*(runs(padded, n, mark) for n in SIZES))


def featured(df: DataFrame, host: str, path: str) -> DataFrame:
    letters = df.withColumn("_grams", F.concat(grams(F.col(host), "h"), grams(F.translate(F.col(path), "0123456789", "0000000000"), "p")))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True).transform(letters)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(label, url): the small labelled table."""
    rows = F.array(*(F.struct(F.lit(y).alias("label"), F.lit(f"http://{u}").alias("url")) for y, text in ((1.0, BLOCK_URLS), (0.0, ALLOW_URLS)) for u in text.split()))
    return spark.range(1).select(F.inline(rows))


def train(spark: SparkSession, labelled: DataFrame | None = None, penalty: float = 0.01) -> LogisticRegressionModel:
    """labelled: (label 0/1, url); by default the small table of this module."""
    if labelled is None:
        labelled = labelled_urls(spark)
    host, path = split_url(F.col("url"))
    rows = featured(labelled.select("label", host.alias("_host"), path.alias("_path")), "_host", "_path")
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=penalty, maxIter=50, standardization=False).fit(rows)


def judge(pages: DataFrame, rules: dict[str, str], model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """rules: rule -> allow or block. Adds the model's probability of block."""
    host, path = split_url(F.col(url_col))
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", rule_of(rules, F.col("host"), F.col("path")))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    scored = model.setFeaturesCol("_features").transform(featured(base, "host", "path"))
    probability = F.when(F.col("host") == "", F.lit(0.0)).otherwise(vector_to_array("probability")[1])
    return scored.select(
        id_col, "host", "path", "rule",
        F.coalesce(said, F.when(probability >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        probability.alias("block_probability"),
    )
