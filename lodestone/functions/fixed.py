"""Word lists, suffix tables, phrases and maps. Results depend on them, so they stand as they are, in their order."""

STOPWORDS = """
a an the and or but in on at to for
of with by from is it as be was were
are been being have has had do does did
will would could should may might shall can
not no nor so if then than that this
these those what which who whom how when
where why all each every both few more
most other some such only own same too
very just about above after again also any
because before between below during into its
out over through under until up while he
she they we you me him her us them
my your his our their here there
edit edited retrieved archived accessed cite
citation isbn issn doi pmid oclc
original wayback pdf
http https www com org html htm php
cookie cookies privacy policy subscribe newsletter
login signup register advertisement sponsored
share tweet facebook twitter instagram
menu previous next skip navigation
""".split()

#: Suffixes in the order they are tried, with what replaces them.
SUFFIXES_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
SUFFIXES_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
SUFFIXES_4 = [
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""),
    ("ant", ""), ("ement", ""), ("ment", ""), ("ent", ""), ("ion", ""), ("ou", ""), ("ism", ""),
    ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
]

BAD_TITLES = ["page not found", "404", "error", "not found", "access denied", "403 forbidden", "untitled", "redirect", "loading", "just a moment"]
REDIRECTS = [
    "you are being redirected",
    "this page has moved",
    "click here if you are not redirected",
    "301 moved permanently",
    "302 found",
    "if you are not redirected",
]

STRIPPED_TAGS = "script style nav footer header noscript aside iframe svg figure table".split()
BOILERPLATE = """
sidebar navbox infobox mw-jump-link reflist references
catlinks toc mw-editsection external_links see_also
mw-navigation mw-panel portal sister-project authority-control
noprint metadata hatnote ambox dmbox tmbox fmbox
breadcrumb cookie popup modal social-share share-bar
newsletter related-articles comments ad- advertisement
footer sidebar widget menu dropdown
ssrcss- gel- bbc-footer orb-
article-meta game-strip scoreboard
dcr- submeta rich-link
quick-select pager
mw-indicators printfooter mw-hidden-catlinks
promo sponsored breaking-news ticker
""".split()
#: Which element holds the article: (host or None, tag, attribute, value, whole value or part), tried in order.
MAIN = [
    ("www.bbc.com", "article", None, None, False),
    ("www.espn.com", "article", None, None, False), ("www.espn.com", "div", "class", "article-body", False),
    ("www.theguardian.com", "div", "id", "maincontent", True), ("www.theguardian.com", "div", "class", "article-body", False),
    (None, "div", "id", "mw-content-text", True), (None, "div", "id", "bodyContent", True),
    (None, "article", None, None, False), (None, "main", None, None, False), (None, "div", "role", "main", True),
    *((None, "div", "class", c, False) for c in ("article-body", "post-content", "entry-content", "story-body", "content-body")),
    (None, "body", None, None, False),
]
#: Cut marks of trailing sections that can still occur once "[edit]" is gone, in the order they are tried.
TRAILING = [" References ", " External links "]

ALLOWED_DOMAINS = ["en.wikipedia.org", "www.bbc.com", "www.espn.com", "www.skysports.com", "www.theguardian.com", "www.transfermarkt.com", "fbref.com"]
BLOCKED_DOMAINS = ["bet365.com", "betfair.com", "williamhill.com", "paddypower.com", "bwin.com", "888sport.com", "unibet.com", "betway.com", "draftkings.com", "fanduel.com"]
ALLOWED_PATHS = ["/sport/football", "/soccer/", "/football", "/en/", "/"]
TOPIC_WORDS = """
football soccer fifa uefa conmebol concacaf afc_
premier_league la_liga serie_a bundesliga ligue_1
eredivisie primeira_liga mls
champions_league europa_league world_cup copa_am
euro_ european_championship
ballon_d golden_boot golden_ball golden_glove
f.c. fc_ a.f.c. s.c._ cf_
_united_f _city_f _athletic _sporting
_national_football _football_club _football_team
_stadium _derby _season
_transfer _goalkeeper _midfielder _striker _defender
_forward_ _winger _manager
_footballer _football_career _international_goal
_cap_ _goal_scorer
""".split()

TEAMS = {
    "arsenal": 42, "manchester united": 33, "man utd": 33, "man united": 33,
    "liverpool": 40, "chelsea": 49, "manchester city": 50, "man city": 50,
    "tottenham": 47, "spurs": 47, "newcastle": 34, "newcastle united": 34,
    "aston villa": 66, "west ham": 48, "brighton": 51, "crystal palace": 52,
    "wolves": 39, "wolverhampton": 39, "everton": 45, "fulham": 36,
    "bournemouth": 35, "brentford": 55, "nottingham forest": 65,
    "barcelona": 529, "barca": 529, "real madrid": 541, "atletico madrid": 530,
    "sevilla": 536, "villarreal": 533, "real sociedad": 548, "athletic bilbao": 531,
    "ac milan": 489, "inter milan": 505, "inter": 505, "juventus": 496,
    "napoli": 492, "roma": 497, "as roma": 497, "lazio": 487, "atalanta": 499,
    "bayern munich": 157, "bayern": 157, "borussia dortmund": 165, "dortmund": 165,
    "rb leipzig": 173, "bayer leverkusen": 168, "leverkusen": 168,
    "psg": 85, "paris saint-germain": 85, "marseille": 81, "lyon": 80,
    "monaco": 91,
    "benfica": 211, "porto": 212, "sporting": 228, "ajax": 194,
    "celtic": 247, "rangers": 257,
    "hoang anh gia lai": 2890, "hagl": 2890, "ha noi fc": 2898,
}
LEAGUES = {
    "premier league": 39, "epl": 39, "english premier league": 39,
    "la liga": 140, "spanish league": 140,
    "serie a": 135, "italian league": 135,
    "bundesliga": 78, "german league": 78,
    "ligue 1": 61, "french league": 61,
    "champions league": 2, "ucl": 2, "uefa champions league": 2,
    "europa league": 3, "europa": 3,
    "eredivisie": 88, "dutch league": 88,
    "liga portugal": 94, "portuguese league": 94,
    "mls": 253,
    "v-league": 340, "v league": 340, "vietnamese league": 340,
    "world cup": 1, "fifa world cup": 1,
}
FIXTURE_WORDS = ["next match", "upcoming", "fixture", "schedule", "next game", "when do", "when does"]
STANDINGS_WORDS = ["standings", "table", "league table", "ranking", "rankings", "leaderboard"]
LIVE_WORDS = ["live score", "live scores", "score", "scores today", "results today", "live"]
H2H_WORDS = ["vs", "versus", "v.", "head to head", "h2h", "against"]
