"""URL filter: host word segmentation, then multinomial naive Bayes over the words of host and path.

1. *Pieces.* A URL's host (without its last label) and path are cut into runs of letters, in lower case; escapes,
   digits, the query and the fragment are left out. The last label (.casino, .bet) isn't cut or listed among the words, but
   scores as one unless it is in ``NEUTRAL``, as country codes are.
2. *Segmentation.* A piece may be a concatenated name ("freebetsnow"). The unigram model is half the relative
   frequencies of words over all texts of all pages, half ``WORDS``, so it doesn't depend on the corpus's size; a
   stretch that is no known word of up to ``LONGEST`` letters costs ``UNKNOWN`` + ``UNKNOWN_LETTER`` for each letter.
   Distinct pieces' substrings are joined with the words, and Viterbi's algorithm takes the likeliest path.
3. *Naive Bayes.* Words of labelled URLs, segmented in the same way, are counted for both labels (plus ``SMOOTHING``). A URL's
   score is the sum of its words' log ratios, with even priors; words without a label say nothing. From
   ``BLOCK`` on it is blocked.

Work is done for each distinct piece and each distinct URL, through joins; nothing that grows with the pages is
broadcast or collected.

Result: (page_id, url, words, score, blocked), a row for each row of ``pages``.

Defined results: a null, empty or malformed URL has the words that can be read from it, perhaps none, with score 0, and is
never blocked; null html has no words; a null page_id is carried on; repeated rows are kept; equal scores are
treated alike (``BLOCK`` itself blocks); between equally likely segmentations the one whose last word is longest
wins, and so on to the left; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

LONGEST = 24
UNKNOWN, UNKNOWN_LETTER = 18.0, 2.3
BLOCK = 1.0
#: added to each word's count for either label
SMOOTHING = 0.2
#: what is blocked; each a name as in a host or path
BAD = """onlinecasino casinoroyal bestcasinobonus luckyslots slotmachine freespins pokerstarz pokeronline livepoker
sportsbetting betnow bettingtips megabets winbigjackpot jackpotwin roulettewin blackjackcasino gamblingonline gamblecity bingowin lottowinner
adultvideo adultmovies adultdating adultchat sexcam livesex sexchat freeporn porntube pornvideos xxxmovies xxxtube hotgirls nudecams nudegirls escortservice escorts erotic
camgirls hookupnow milfdating cheapviagra buyviagra buycialis cialisonline pharmacypills discountpills dietpills steroidsbuy paydayloan quickloans instantloan
replicawatches fakerolex fakepassport crackedsoftware warezdownload keygencrack serialcrack torrentcrack hackaccount getrichquick earnfastcash makemoneyfast
freeiphone freegiftcard cryptodoubler bitcoindoubler phishinglogin adserver adsystem adservice adnetwork adclick adbanner bannerads popupads popunder textads nativeads mobileads adsdelivery adexchange adtech doubleads
tracker trackers adtracking eventtrack clicktrack usertrack mailtrack pixeltracker clicktracker webtracker usertracking telemetry webbeacon clickstats affiliatelinks clickbait
spam spammer spambot spammail massmailer bulkmail linkspam linkfarm contentfarm trafficbot
malware malwaredrop trojan trojandownload ransomware spyware adware keylogger rootkit botnet exploitkit fakeantivirus phishing phisher fakelogin accountverify
pharmacy onlinepharmacy pharma levitra xanax tramadol oxycontin canadianpharmacy weightlosspills gambling wagering wager betting bookmaker sportsbook baccarat craps
adultsite adulttoys adultcams adultclips adultpics adultstore adsmanager adsense adsnetwork adspopup ads bet xxx porn sex casino bets poker viagra escort warez nude slots""".split()
#: what is not
GOOD = """dailynews worldnews localnews newsroom weatherreport sciencemuseum artmuseum cityhall publiclibrary universitypress highschool mathlessons
historyproject openscience researchlab medicaljournal healthadvice cityhospital familydoctor gardenguide homegarden cookingrecipes easyrecipes breadrecipe
travelguide hotelbooking cheapflights trainschedule bustickets carrepair bikeshop bookstore bookclub musicschool pianolessons filmreview moviereview
adulteducation adultlearning freesoftware freedownload freeshipping freelancer freebooks opensource codeforum developerblog techblog photoblog myblog personalpage homepage
onlineshop onlinecourse onlinestore customerservice supportforum helpdesk contact about privacy terms archive article articles category tag author
news forum shop wiki docs mail post posts product products search login account images static assets files about-us footballscores soccerclub chessclub gamereview videogames boardgames windpower winter windows wine winery
loanlibrary studentloan betterhome betterhealth sussex essex expertsexchange girlscouts livestream livemusic giftshop watchrepair cashregister
farm farming farmhouse organicfarm familyfarm farmmarket racetrack trackandfield athletics runningtrack trackrecord soundtrack parceltracking packagetracking ordertracking
pillow pillows bannermaking bannerprinting clickandcollect linkedlibrary mailinglist servermanual networknews exchangerate antivirus virusresearch trafficnews trafficreport
adviceline advancedmaths address adaptor adventure systembooks deliverymenu banners pixelart pixelcamera lighthousebeacon""".split()
#: what says nothing; counted for both labels
NEUTRAL = "www m mobile blog web example index page pages home main site en de fr es it pt html htm php a b c x y".split()
#: words that the model knows whatever the corpus
WORDS = """the of and to in is for on with by at from this that it as are was be have not all can more new free best top big live online now here fast quick
easy cheap buy get make win wins winner luck lucky play bet bets better betting casino slot slots spin spins poker stars star royal bonus sport sports book
books tips mega jackpot roulette black jack blackjack gamble gambling bingo lotto city machine adult video videos dating chat sex cam cams porn tube xxx movie movies
hot girl girls nude escort escorts service erotic hookup milf viagra cialis pharmacy pill pills diet steroid steroids payday loan loans instant replica watch
watches fake rolex passport cracked crack software warez download keygen serial torrent hack account rich earn cash money phone gift card crypto doubler bitcoin phishing login
click daily news world local room weather report science museum art hall public library university press high school math lessons history project open
research lab medical journal health advice hospital family doctor garden guide home cooking recipes recipe bread travel hotel booking flights train schedule
bus tickets car repair bike shop store club music piano film review education learning lancer freelance freelancer source code forum developer blog tech photo my personal page pages
course customer support help desk contact about privacy terms archive article articles category tag author wiki docs mail mobile example index post posts product
products search images static assets files us football scores soccer chess game games board wind power winter windows wine winery student essex sussex expert experts exchange scouts stream
ad ads server banner banners popup network click clicks native delivery exchange track tracker trackers tracking pixel telemetry beacon stats affiliate links link bait traffic bot
spam spammer mailer mass bulk farm farming content malware drop virus trojan ransomware spyware adware keylogger rootkit botnet exploit kit antivirus phishing phisher verify
pharma levitra xanax tramadol oxycontin canadian weight loss wagering wager bookmaker baccarat craps discount organic house market race and field athletics running record sound parcel package order
pillow pillows making printing collect linked list manual rate research report line advanced maths address adaptor adventure system menu camera light lighthouse
site toys clips pics store manager sense event user mail web
register vip pro club zone hub site web net link day time life love work free house food kids""".split()


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def pieces(url: Column) -> Column:
    """Runs of letters of host and path; of a host without scheme too."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//|[?#][\s\S]*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/@]*@)?([^/:]*)", 1), r"\.[^.]*\.?$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(/[\s\S]*)$", 1), "%[0-9A-Fa-f]{2}", " ")
    return letters(F.concat(host, F.lit(" "), path))


def last_label(url: Column) -> Column:
    """The host's last label in lower case, or the empty string."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//|[?#][\s\S]*$", "")
    return F.lower(F.regexp_extract(F.regexp_extract(bare, r"^(?:[^/@]*@)?([^/:]*)", 1), r"\.(\p{L}+)\.?$", 1))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over all texts of all pages."""
    text = F.regexp_replace(F.col("html").cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    return pages.select(F.explode(letters(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(piece: str, known: dict[tuple[int, int], float]) -> list[str]:
    """The likeliest words of ``piece``; known has ln p of its stretches (begin, end) that are words."""
    best, back = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
    for end in range(1, len(piece) + 1):
        for begin in range(max(0, end - LONGEST), end):
            p = best[begin] + known.get((begin, end), -UNKNOWN - UNKNOWN_LETTER * (end - begin))
            if p > best[end]:
                best[end], back[end] = p, begin
    out, end = [], len(piece)
    while end:
        out.append(piece[back[end] : end])
        end = back[end]
    return out[::-1]


def _segment(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        words = [viterbi(piece, {(b, e): p for b, e, p in zip(begin, end, ps)}) for piece, begin, end, ps in zip(*(batch.column(c).to_pylist() for c in ("piece", "begins", "ends", "ps")))]
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(words, pa.list_(pa.string()))], ["piece", "words"])


def segment(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) for each of the distinct pieces."""
    spark = distinct.sparkSession
    base = spark.createDataFrame([(w, 0.5 / len(set(WORDS))) for w in sorted(set(WORDS))], "word string, p double")
    counts = scratch.materialise(counts.filter(F.length("word") <= LONGEST), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    model = counts.select("word", (F.col("n") * (0.5 / total)).alias("p")).unionByName(base).groupBy("word").agg(F.log(F.sum("p")).alias("p"))
    spans = F.expr(f"flatten(transform(sequence(0, length(piece) - 1), i -> transform(sequence(1, least({LONGEST}, length(piece) - i)), n -> struct(i AS begin, i + n AS end, substring(piece, i + 1, n) AS word))))")
    found = distinct.select("piece", F.explode(spans).alias("s")).select("piece", "s.*").join(model, "word")
    known = found.groupBy("piece").agg(F.collect_list(F.struct("begin", "end", "p")).alias("k"))
    empty = F.expr("array()")
    whole = distinct.join(known, "piece", "left").select("piece", *(F.coalesce(F.col(f"k.{c}"), empty.cast(f"array<{t}>")).alias(f"{c}s") for c, t in (("begin", "int"), ("end", "int"), ("p", "double"))))
    return whole.mapInArrow(_segment, "piece string, words array<string>")


def log_ratios(labelled: DataFrame) -> DataFrame:
    """(word, ratio) of rows (words, bad): ln of the words' probabilities among bad URLs over those among good ones."""
    word = labelled.filter("bad IS NOT NULL").select(F.explode("words").alias("word"), F.col("bad").cast("boolean").alias("bad"))
    n = word.groupBy("word").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))
    t = n.agg(F.coalesce(F.sum("n_bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("n_good"), F.lit(0)).alias("g"), F.count("*").alias("v")).first()
    return n.select("word", (F.log((F.col("n_bad") + SMOOTHING) / (t["b"] + SMOOTHING * t["v"])) - F.log((F.col("n_good") + SMOOTHING) / (t["g"] + SMOOTHING * t["v"]))).alias("ratio"))


def builtin_labels(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame([(f"http://{n}.com/", b) for b, names in ((True, BAD + NEUTRAL), (False, GOOD + NEUTRAL)) for n in names], "url string, bad boolean")


def url_filter(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """labelled: (url, bad) to train on instead of the built-in names."""
    labelled = (builtin_labels(pages) if labelled is None else labelled.select(F.col("url").cast("string"), F.col("bad").cast("boolean"))).select(pieces(F.col("url")).alias("pieces"), "bad")
    urls = scratch.materialise(pages.select(F.col("url").cast("string").alias("url")).filter("url IS NOT NULL").distinct().select("url", pieces(F.col("url")).alias("pieces")), "urls")
    distinct = urls.select(F.explode("pieces").alias("piece")).unionByName(labelled.select(F.explode("pieces").alias("piece"))).distinct()
    segmented = scratch.materialise(segment(distinct, word_counts(pages)), "segmented")
    known = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode("pieces").alias("piece")).join(segmented, "piece")
    ratios = log_ratios(known)
    of_word = segmented.select("piece", F.posexplode("words").alias("at", "word")).join(ratios, "word", "left")
    scored = of_word.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"), F.sum(F.coalesce("ratio", F.lit(0.0))).alias("score"))
    by_url = urls.select("url", F.posexplode("pieces").alias("at", "piece")).join(scored, "piece").groupBy("url")
    in_order = F.array_sort(F.collect_list(F.struct("at", "words", "score")))
    url_scores = by_url.agg(in_order.alias("x")).select(F.col("url").alias("_url"), F.flatten("x.words").alias("_words"), F.aggregate("x.score", F.lit(0.0), lambda a, b: a + b).alias("_score"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    label = ratios.filter(~F.col("word").isin(NEUTRAL)).select(F.col("word").alias("_label"), F.col("ratio").alias("_ratio"))
    score = F.round(F.coalesce("_score", F.lit(0.0)) + F.coalesce("_ratio", F.lit(0.0)), 4)
    return rows.join(url_scores, rows["url"] == url_scores["_url"], "left").join(label, last_label(rows["url"]) == label["_label"], "left").select("page_id", "url", F.coalesce("_words", F.expr("cast(array() as array<string>)")).alias("words"), score.alias("score"), (score >= BLOCK).alias("blocked"))
