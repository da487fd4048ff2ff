"""Rule tables: market closes, sections, event vocabulary.

The tables are data that the caller may replace; the operators compile whatever table they get.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The four sections of an edition, in print order.
SECTIONS = ("Merger Arbitrage", "Fundamental/Pre-Event", "Relative Value", "Other Strategy")
DEFAULT_SECTION = "Other Strategy"

# Desk close of each market (local clock).
MARKET_CLOSES = (
    ("JP", "Asia/Tokyo", "15:30", "normal weekday close"),
    ("KR", "Asia/Seoul", "15:30", "normal weekday close"),
    ("AU", "Asia/Singapore", "14:15", "fixed SGT desk cutoff"),
    ("HK", "Asia/Hong_Kong", "16:10", "normal weekday close"),
    ("CH", "Asia/Shanghai", "15:00", "normal weekday close"),
    ("TT", "Asia/Taipei", "13:30", "normal weekday close"),
    ("NZ", "Pacific/Auckland", "17:00:30", "normal weekday close"),
    ("SP", "Asia/Singapore", "17:16", "normal weekday close"),
    ("IN", "Asia/Kolkata", "15:30", "normal weekday close"),
    ("MK", "Asia/Kuala_Lumpur", "17:00", "normal weekday close"),
    ("IJ", "Asia/Jakarta", "16:15", "normal weekday close"),
    ("TB", "Asia/Bangkok", "16:40", "normal weekday close"),
    ("PM", "Asia/Manila", "15:15", "normal weekday close"),
    ("VN", "Asia/Ho_Chi_Minh", "15:00", "normal weekday close"),
)

# Other codes of the same markets.
MARKET_ALIASES = {"CN": "CH", "TW": "TT", "SG": "SP", "MY": "MK", "KS": "KR", "KQ": "KR", "ID": "IJ", "TH": "TB", "PH": "PM"}

SESSION_HORIZON_DAYS = 370


def market_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MARKET_CLOSES), "market string, timezone string, close string, basis string")


@dataclass(frozen=True)
class EventRule:
    """One event type. ``strip`` removes other senses before the test; ``strip_context`` is removed
    as well when ``context`` matches the whole text and no business wording does."""

    event_type: str
    category: str
    score: int
    pattern: str
    strip: str | None = None
    context: str | None = None
    strip_context: str | None = None


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[EventRule, ...]
    macro: str
    business: str


# Event vocabulary in English, Japanese, Chinese and Portuguese, with the score of
# each event type. Matching ignores case.
TENDER = (
    r"\b(?:tender offer|takeover offer|public offer for (?:the )?shares|"
    r"offer (?:price|period)|squeeze[ -]out|TOB|MBO|go[ -]private|going private)\b"
    r"|(?<![A-Za-z])(?:TOB|MBO)(?![A-Za-z])|公開買付|公開買い付け|株式非公開化|非公開化|要約收購|要约收购|公開收購|公开收购"
    r"|oferta p[uú]blica de aquisi[çc][aã]o")
DEAL = (
    r"\b(?:mergers?|acquisitions?|takeovers?|buyouts?|M\s*&\s*A|"
    r"merger agreement|scheme of arrangement|sale of (?:a |the |its )?(?:business|unit|subsidiary)|"
    r"strategic alternatives|strategic review|acquire[sd]?|acquiring)\b"
    r"|\b(?:buy[si]?|bought|purchase[sd]?)\s+(?:(?:its|a|the)\s+)?(?:rival|competitor|company|business|stake)\b"
    r"|(?<![A-Za-z])M\s*&\s*A(?![A-Za-z])|買収|合併|経営統合|事業売却|身売り|收購|收购|併購|并购|兼併|兼并|出售子公司"
    r"|\b(?:aquisi[çc][aã]o|fus[aã]o|incorpora[çc][aã]o)\b")
RESTRUCTURING = (
    r"\b(?:spin[ -]?offs?|demergers?|debt restructuring|corporate restructuring|"
    r"bankruptcy|chapter 11|receivership|insolvency|delisting|break[ -]up of)\b"
    r"|会社分割|事業再編|経営再建|民事再生|会社更生|上場廃止|スピンオフ|分拆上市|分拆|破產|破产|退市"
    r"|資產重組|资产重组|債務重組|债务重组|recupera[çc][aã]o judicial|cis[aã]o")
OWNERSHIP = (
    r"\b(?:activist (?:investor|fund|shareholder)|shareholder activism|proxy (?:fight|contest)|"
    r"(?:buys?|acquires?|raises?|increases?|cuts?|sells?|takes?|builds?)\s+(?:\w+\s+){0,5}stake|"
    r"(?:major|significant|controlling|minority|majority) (?:stake|shareholding)|"
    r"beneficial ownership|disclosure of interest|board challenge)\b"
    r"|アクティビスト|物言う株主|大量保有|株主提案|持ち分取得|持分取得|股東維權|股东维权"
    r"|增持股份|減持股份|减持股份|大股東增持|大股东增持|股權收購|股权收购"
    r"|investidor ativista|participa[çc][aã]o acion[aá]ria")
RETURNS = (
    r"\b(?:share buybacks?|stock buybacks?|buyback (?:program|programme)|"
    r"share repurchases?|stock repurchases?|special dividend|return of capital|"
    r"(?:raises?|cuts?|suspends?|increases?|reduces?) (?:its |the )?dividend|stock split|share split)\b"
    r"|自社株買い|自己株式取得|自己株式の取得|自己株式消却|増配|減配|無配|株式分割"
    r"|股份回購|股份回购|回購股份|回购股份|特別股息|特别股息|特別息|特别息|recompra de a[çc][oõ]es")
RESULTS = (
    r"\b(?:earnings|profit warning|profit forecast|revenue forecast|"
    r"(?:raises?|cuts?|lowers?|withdraws?|upgrades?|downgrades?) (?:its |the )?(?:guidance|outlook)|"
    r"(?:quarterly|annual|half[ -]year|full[ -]year|financial) results|"
    r"(?:net |operating )?profit (?:rises?|falls?|jumps?|drops?|surges?|slumps?)|"
    r"revenue (?:rises?|falls?|jumps?|drops?|surges?|slumps?))\b"
    r"|決算|業績予想|上方修正|下方修正|増益|減益|赤字転落|黒字転換|業績預告|业绩预告"
    r"|盈利預警|盈利预警|盈利警告|財報|财报|業績指引|业绩指引|純利益|純利潤|净利润"
    r"|resultados financeiros|lucro l[ií]quido")
CAPITAL = (
    r"\b(?:IPO|initial public offering|rights (?:issue|offering)|capital raising|"
    r"equity (?:raising|offering|placement)|share placement|private placement|"
    r"secondary offering|follow[ -]on offering|convertible bonds?|"
    r"(?:bond|debt) issuance|(?:issues?|sells?) (?:\w+\s+){0,4}(?:new shares|bonds))\b"
    r"|(?<![A-Za-z])IPO(?![A-Za-z])|新規上場|新規株式公開|公募増資|第三者割当|転換社債|起債|首次公開招股|首次公开招股"
    r"|配股|供股|增發|增发|可轉債|可转债|oferta inicial de a[çc][oõ]es")
REGULATION = (
    r"\b(?:antitrust|competition (?:authority|regulator|clearance|probe)|"
    r"merger (?:clearance|approval|review)|FIRB|CFIUS|ACCC|"
    r"(?:regulator|regulators|court) (?:blocks?|approves?|clears?|fines?|rejects?)|"
    r"FDA (?:approves?|rejects?|clearance|approval)|securities fraud|class[ -]action lawsuit)\b"
    r"|独禁法|独占禁止法|公正取引委員会|企業結合審査|反壟斷|反垄断|經營者集中|经营者集中"
    r"|aprova[çc][aã]o do CADE|defesa da concorr[eê]ncia")
BUSINESS = (
    r"\b(?:companies|company|corporation|corp|holdings|plc|shareholders?|shares|stocks?|"
    r"equity|revenue|profits?|business|banks?|manufacturer|factory|factories|CEO|CFO|"
    r"billion|million|semiconductors?|chipmaker|retailer|investors?|funds?|subsidiary)\b"
    r"|[$€£¥]\s*\d|企業|株式会社|株式|株主|上場|売上高|営業利益|社長|金融|半導体|事業"
    r"|公司|股東|股东|股份|上市|股價|股价|營收|营收|企業|企业|董事"
    r"|\b(?:empresa|companhia|a[çc][oõ]es|lucro)\b")
MACRO = (
    r"\b(?:inflation|interest rates?|central bank|federal reserve|GDP|bond yields?|"
    r"unemployment|currency|currencies|forex|oil prices?|gold prices?|tariffs?|"
    r"Nikkei index|Hang Seng|stock market|equity market|market rally)\b"
    r"|金利|金融政策|日銀|日本銀行|インフレ|為替|消費者物価|失業率|日経平均"
    r"|恒生指數|恒生指数|通脹|通胀|通縮|通缩|央行|貨幣政策|货币政策|關稅|关税|利率")

# Senses of deal words that are not corporate events.
OTHER_SENSES = (
    r"\b(?:language|skill|knowledge|data|image|signal) acquisition\b|"
    r"\bacquisition of (?:language|skills?|knowledge|data|images?|signals?)\b|"
    r"\b(?:black[ -]?hole|neutron[ -]?star|galaxy|galactic|stellar) mergers?\b|"
    r"\bmergers? of (?:black holes|neutron stars|galaxies)\b|"
    r"\b(?:acquire[sd]?|acquiring)\s+(?:new\s+)?(?:skills?|knowledge|language|immunity|infection)\b"
    r"|銀河合併|星系合併|星系合并|スキルの獲得")
AMBIGUOUS_VERBS = r"\b(?:acquire[sd]?|acquiring|acquisitions?|incorpora[çc][aã]o)\b"
PERSONAL_PURCHASE = (
    r"\b(?:museum|gallery|collector|collectors|tourist|tourists|student|students)\b.*"
    r"\b(?:painting|portrait|artwork|artworks|artifact|artefact|book|books|souvenir|souvenirs)\b")

DEFAULT_RULES = RuleSet(
    rules=(
        EventRule("Tender/deadline", "Merger Arbitrage", 94, TENDER),
        EventRule("Deal terms/process", "Merger Arbitrage", 88, DEAL, OTHER_SENSES, PERSONAL_PURCHASE, AMBIGUOUS_VERBS),
        EventRule("Restructuring/spin-off", "Fundamental/Pre-Event", 84, RESTRUCTURING),
        EventRule("Ownership/activism", "Fundamental/Pre-Event", 80, OWNERSHIP),
        EventRule("Buyback/capital return", "Fundamental/Pre-Event", 76, RETURNS),
        EventRule("Results/guidance", "Fundamental/Pre-Event", 72, RESULTS),
        EventRule("Capital raising/IPO", "Fundamental/Pre-Event", 73, CAPITAL),
        EventRule("Regulatory decision", "Fundamental/Pre-Event", 74, REGULATION),
    ),
    macro=MACRO,
    business=BUSINESS,
)

# First-match labels of a candidate, and the topic pattern that "m&a" stands for.
EVENT_LABELS = (
    ("Tender/deadline", r"\b(tender|TOB|last day|deadline|delist|squeeze.out)\b"),
    ("Court/shareholder vote", r"\b(court|scheme|vote|shareholder approval|EGM)\b"),
    ("Regulatory decision", r"\b(antitrust|regulator|clearance|ACCC|CADE|FIRB|CFIUS|aprova\w*)\b"),
    ("Deal terms/process", r"\b(merger|acquisition|takeover|offer|exclusivity|buyout|bid|go.shop)\b"),
    ("Ownership", r"\b(stake|shareholding|shareholder|buys shares|disclosure of interest)\b"),
    ("Results/guidance", r"\b(results|earnings|guidance|EBITDA|dividend)\b"),
    ("Capital raising/IPO", r"\b(IPO|listing|issuance|senior notes|bond|capital raising)\b"),
)
DEFAULT_EVENT_LABEL = "Company update"
TOPIC_NAMES = ("m&a", "ma", "mergers")
TOPIC_PATTERN = (
    r"\b(merger|acquisition|takeover|tender|TOB|bid|buyout|scheme|antitrust|exclusivity|go.shop|M&A|offer price|acquire)\b"
    r"|買収|合併|TOB|公開買付|非公開化|aquisi[çc][aã]o|fus[aã]o")
