"""Fixed values of the boilerplate classifier: words of page furniture, and the labelled pages it is trained on."""

# Entries of menus.
NAV = set(
    "currencies|video|freight|search|watchlist|world|property|bonds|crypto|screener|archive|events|sign in|help|podcasts|markets|tech|metals|subscribe|careers|charts|"
    "newsletters|weather|autos|glossary|opinion|alerts|funds|calendar|data|home|energy|about us|jobs|contact|terms|privacy|site map|login|register|"
    "首页|公告|外汇|新股|汽车|自选股|股吧|搜索|注册|视频|黄金|登录|债券|宏观|银行|基金|理财|期货|专题|港口|行情|保险|产经|博客|客户端|帮助|数据|研报|直播|房产|关于我们|联系方式|网站地图|"
    "anmelden|suche|startseite|technik|meinung|märkte|rechner|wetter|fonds|energie|abo|depot|immobilien|archiv|anleihen|hilfe|fracht|metalle|termine|impressum|kontakt|agb|datenschutz".split("|")
)
# Headings of lists of other articles.
LABELS = (
    r"trending now|related stories|sponsored|editor's picks|latest headlines|in other news|more from this section|most read|you may also like|recommended for you|"
    r"read (?:more|next)|popular now|more stories|advertisement|"
    r"广告|猜你喜欢|相关(?:阅读|文章|新闻)|推荐阅读|更多>>|点击排行|0小时热榜|热门(?:文章|推荐|阅读)|延伸阅读|"
    r"im fokus|weitere (?:themen|artikel|meldungen)|neueste meldungen|empfehlungen|das könnte sie (?:auch )?interessieren|top 0|mehr zum thema|meistgelesen|anzeige|lesen sie auch"
)
# Beginnings of consent notices, footers, bylines, notices of law and share prompts.
CUES = (
    r"your privacy matters:|consent settings\b|accept all \||we and 0 partners|this site stores small files|we use cookies|本站会在您的设备|我们使用cookie|隐私设置[:：]|全部接受 [/|·]|"
    r"wir verwenden cookies|datenschutz: 0|alle akzeptieren \||diese seite (?:speichert|verwendet)|wir und 0 partner|"
    r"registered office:|©|版权所有|违法和不良信息举报|友情链接|客服时间|返回顶部|关于我们 \||impressum ·|seitenanfang\b|sitz der gesellschaft:|back to top|follow us:|"
    r"download our .{0,30} app\b|terms · |about us \||folgen sie uns|unsere .{0,30}app\b|kundendienst|"
    r"by the .{2,40} desk$|editing by |reporting by |written by |von der .{2,40} redaktion|责任编辑|\(来源[:：]|编辑[:：]|"
    r"this report may not be reproduced|all times local unless stated|.{2,40} accepts no liability|this is not investment advice|figures are unaudited and may|"
    r"correction follows if|past performance is|未经.{1,30}授权不得转载|风险提示[:：]|以上数据未经审计|本文不构成任何投资建议|如有更正,另行通知|本文仅代表作者观点|"
    r"nachdruck nur mit|dieser beitrag gibt nicht die meinung|angaben ohne gewähr|keine anlageberatung|wertentwicklungen? der vergangenheit|"
    r"read by 0|sign up for the .{2,40} letter|got a tip\?|share this story|扫码下载|更多内容请关注|分享到|jetzt teilen|bisher 0 leser|haben sie einen hinweis"
)

# Labelled pages, invented: "+" main body, "-" not main body.
PAGES = """
- Home | Markets | Bonds | Funds | Sign in
+ Tolbeck Marine said revenue from port cranes rose 3.1 percent to 40.2 million in the quarter ended May 3.
+ Outlook: Tarnmouth
+ The board of Tolbeck Marine approved a buyback of up to 3.5 million shares over 6 months. Two suppliers confirmed it.
+ Tolbeck Marine Q2 | 31.4 | 28.8 | -2.7%
+ Short interest eased to 3.14 percent of the float, data for the week to June 4 showed.
- This report may not be reproduced without written consent of Tarn Wire.
- Related stories
- Tolbeck Marine lifts port cranes target by 4.4 percent
- 3. Tarnmouth plant adds 120 MW for Halbeck Grid (12 min)
- Halbeck Grid to buy back 4.1 million shares
- Registered office: 3 Quay Street, Tarnmouth
- Follow us: feed / Video / app — 12 followers
- Back to top ↑ Funds page 31

- Screener
- Weather
- Energy
- Sign in
- Podcasts
+ Halbeck Grid rewrote its ordering app in JavaScript and cut 12 support jobs in Tarnmouth.
+ What changed: Tarnmouth
+ Cash from operations was 12.5 million against 10.2 million a year earlier, while receivables grew by 1.0 million.
- Read by 12 subscribers | tell us what you think
+ Port officials asked Halbeck Grid for 12 further documents before June 9.
- This is not investment advice.
- Trending now
- Halbeck Grid holds solar glass target by 3.2 percent (3 min)
- - Tarnmouth tender adds 30 MW for Halbeck Grid

- Your privacy matters: choose which of our 12 partners may store data.
+ A second furnace at Tarnmouth tripped on May 3 and output fell 3.5 percent for 4 days.
+ Background port cranes
+ Regulators asked Halbeck Grid for 4 further documents before June 30.
+ Halbeck Grid Q3 | 45.4 | 86.8 | -5.7%
+ Halbeck Foods Q3 | 15.4 | 16.8 | 5.7%
+ Under the contract, Halbeck Grid delivers subsea cable worth 20.1 million through 2028.
- By the Tarn Wire metals desk
- All times local unless stated, Tarn Wire
- Accept all | Reject all | Manage choices (12)
- About us | Home | Jobs | Tech | Site map 22
- Terms · Privacy · Property · Contact · www.tarnwire.example

- Metals  Archive  Subscribe  Freight
- We use cookies to measure visits. By continuing you agree to our cookie policy.
+ Readers sign up for power plans at 12 branches, and Halbeck Grid follows up within 2 days.
+ The privacy regulator fined Halbeck Grid 2.1 million over cookie consent.
- Sign up for the Tarn Wire evening letter, sent 12 times so far
- Tarn Wire accepts no liability for trading losses based on this text.
+ Volume in battery cells reached 3.9 billion, with two groups making up 59.8 percent of it.
- Got a tip? Write to the Tarn Wire newsroom, box 23
- Figures are unaudited and may change.
- Correction follows if needed.
- Past performance is not a guide to later returns.
- Sponsored
- Halbeck Foods misses drive motors target by 29.1 percent (13 min)
- © 2021 www.tarnwire.example · Tech. All rights reserved.
- Download our Home app (version 3.1)

- [+] Freight, Crypto, Alerts, Energy
- Energy » Help » Home
+ Analysts tracking solar glass had expected a margin near 5.6 percent, about 78 basis points below the reported figure.
+ Its outage page returned error 503 to 688 customers on November 18, and orders slipped 1.7 percent.
- Share this story with a colleague at tarnwire.example
- Consent settings — 34 vendors listed
- This site stores small files on your device to show better ads.
- We and 23 partners process data to limit repeats. OK

+ Inventories of solar glass stood at 12.5 thousand tonnes, the lowest since May 2021.
+ Figures: solar glass
+ Management kept its full-year guidance of 2.4 to 5.7 million, citing weak orders.
- Editing by the Tarn Wire night desk

+ Spot prices for solar glass in Tarnmouth slid near 951 a tonne, traders at 9 desks said. Planners asked for 14 documents.

- 首页 | 行情 | 基金 | 登录
+ 青原重工第二季度海外收入占比12.5%，主要来自青港出口的光伏玻璃。
+ 公司回应: 青港
+ 截至5月3日收盘，青原重工报12.50元，上涨1.25%，成交额3.10亿元。
+ 青原重工一季度 | 23.8 | 22.6 | -1.1%
+ 监管部门就Cookie授权问题对青原重工罚款12.5万元。
- （来源：青原报 编辑：夜班三组）
- 未经青原报授权不得转载
- 推荐阅读
- 青原重工回购进展 涉及12万股
- 3. 青原重工：光伏玻璃业务增长3.5%
- 青港光伏玻璃项目验收，规模12兆瓦 06-05
- 版权所有 © 2022 news.qingyuan.example 青港 备案号12
- 返回顶部 新股 共12页

- ☰ 基金 - 数据 - 理财 - 宏观
- 搜索 > 汽车 > 公告
- 注册
- 债券
- 自选股
+ 机构调研记录显示，青原重工现有员工123人，计划新增岗位12个。板块内12家公司收绿。
+ 后市展望 青港
+ 青原重工招聘JavaScript工程师12名，地点青港。
- 风险提示：股市有风险，青原报提醒您谨慎入市
- 以上数据未经审计。
- 我们使用Cookie以改进体验，继续浏览即表示同意。
- 关于我们 | 首页 | 联系方式 | 登录 | 网站地图 12

- 隐私设置：共有12家合作方可能为优化广告存储数据
+ 5月3日，青港产线因限电停工3天，影响产量约3.5%。
+ 供给端: 光伏玻璃
+ 分析人士认为，光伏玻璃价格在12万元一线企稳，库存约12.3万吨。
- 扫码下载青原报客户端，第12期抽奖进行中
- 更多内容请关注青原报公众号
- 本文不构成任何投资建议。
- 如有更正，另行通知。
- 责任编辑：青原报值班组3
- 广告
- - 青港光伏玻璃项目延期，规模12兆瓦
- 青原重工增持进展 涉及8万股
- 违法和不良信息举报：青港分机12
- 友情链接：青港在线 青港网
- 客服时间 9:00-18:00 研报

- 本站会在您的设备上保存文件以推荐内容。
+ 公司与青原重工签订供货协议，2026年前供应海底电缆合计9.5亿元。批次825于青港验收。
- 分享到朋友圈 已有12人阅读
- 本文仅代表作者观点，不构成投资建议，青原报不承担责任。
- 更多>>
- 青原重工：光伏玻璃业务提速12.5% 09-15

- Startseite
- Hilfe
- Anmelden
- Märkte
+ Der Rückkauf von Halbeck Grid umfasst bis zu 12 Millionen Aktien in 8 Monaten.
+ Hintergrund: Solarglas
+ Die Behörde verlangt von Halbeck Grid bis zum 20. Mai noch 11 Unterlagen. Der Ofen fiel aus.
+ Halbeck Grid Q4 | 85 | 67 | 3 %
+ Die Aktie von Halbeck Grid schloss am 3. Mai schwächer bei 12,48 nach dünnem Handel.
- Nachdruck nur mit Erlaubnis von Tarner Blatt
- Von der Tarner Blatt Redaktion Company
- Neueste Meldungen
- Solarglas: Werk Tarnau mit 12 neuen Linien
- - Halbeck Grid bestätigt Prognose auf 31 Millionen
- Halbeck Grid senkt Prognose auf 71 Millionen (27 min)
- Impressum · Metalle · Kontakt · AGB 53 · Fracht
- Seitenanfang · Termine 12
- Sitz der Gesellschaft: Tarnau, HRB 12, Technik

- Fracht > Anmelden > Wetter > Technik
- Wir verwenden Cookies, um Besuche zu messen. Mit der Nutzung stimmen Sie zu.
+ Bestände an Solarglas lagen bei 12 Tausend Tonnen, 12 Prozent unter dem Vorjahr.
+ Ausblick Tarnau
+ Für 2031 erwartet Halbeck Grid eine Marge von 5,8 Prozent.
- Jetzt teilen und Tarner Blatt folgen
- Bisher 12 Leser haben diesen Artikel bewertet
- Dieser Beitrag gibt nicht die Meinung von Tarner Blatt wieder.
- Keine Anlageberatung.
- Angaben ohne Gewähr.
- Datenschutz: 12 Partner speichern Daten, um Werbung anzupassen
- Alle akzeptieren | Ablehnen | Depot (12)
- © 2021 www.tarnerblatt.example – Suche – Alle Rechte vorbehalten

+ Halbeck Grid Q1 | 12.4 | 11.8 | 2.7%
+ Halbeck Grid employs 123 people and plans to hire 12 of them by 2024 Q1.
- Editing by the Tarn Wire night desk
+ Two suppliers confirmed that orders placed before May 3 would ship a week late.
- More from this section
- Tarnmouth terminal adds 12 MW for Halbeck Grid
- Halbeck Foods lifts solar glass target by 3.4 percent (13 min)
+ Under the contract, Halbeck Grid delivers recycled lithium worth 3.4 million through 2025.
+ What changed in specialty steel and recycled lithium
+ Halbeck Grid Q2 | 12.4 | 11.8 | 2.7%
+ Halbeck Grid Q3 | 12.4 | 11.8 | 2.7%
- Editing by the Tarn Wire night desk

+ By the numbers: specialty steel in Tarnmouth
+ The plant in Tarnmouth will add 12 lines for drive motors and is due to start by 2022 Q2.
- By the Tarn Wire desk
+ The board approved a buyback of up to 17.6 million shares over 10 months.
+ Supply side recycled lithium
- Read by 12 subscribers | tell us what you think
+ Port officials asked for 34 further documents before October 25.
+ By the numbers recycled lithium
- Your privacy matters: choose which of our 12 partners may store data.
- In other news
- Halbeck Steel to buy back 12.1 million shares
- Correction follows if needed.

- Home Markets Bonds Energy Search
- Sign in
+ Background: subsea cable
+ Management kept its full-year guidance of 10.4 to 53.0 million, pointing to weak orders.
+ Halbeck Grid Q2 | 12.4 | 11.8 | 2.7%
- Got a tip? Write to the Tarn Wire newsroom, box 23
+ Halbeck Marine Q2 | 12.4 | 11.8 | 2.7%
- Sponsored
- Halbeck Power misses solar glass target by 1.4 percent

+ 青原重工融资余额减少5.35亿元，青港席位净买入0.10亿元。
- 扫码下载青原报客户端，第3期抽奖进行中
+ 青原重工董事会第3次会议于7月3日召开，应到董事7人，审议通过12项议案。
- 未经青原报授权不得转载
+ 报告期内，青原重工研发投入为3.53亿元，较上年增加1.8%。
- 风险提示：股市有风险，青原报提醒您谨慎入市
+ 青原重工股份管理层维持全年出货4吉瓦时的目标。
+ 数据一览: 港口起重机
- 热门文章
- 青原重工减持进展 涉及12万股 06-05
- 青港再生锂项目招标，规模63兆瓦
- 青原重工：动力电芯业务承压7.1%
+ 青原重工拟以不超过1.6亿元回购股份，期限8个月，价格上限2.3元。
- （来源：青原报 编辑：夜班三组）
+ 背景 电网储能
+ 青原重工一季度 | 12.4 | 11.8 | 2.7%
- 更多内容请关注青原报公众号

+ 青原重工一季度 | 12.4 | 11.8 | 2.7%
+ 青港有关部门要求青原重工在3月9日前补充3份材料。
+ 青原电池集团一季度 | 2.4 | 1.8 | -2.7%
- 延伸阅读
- 7. 青港特种钢项目开工，规模63兆瓦
- 青原重工定增进展 涉及12万股
- 以上数据未经审计。

- 宏观 期货 行情 自选股 外汇
- 全部接受 / 全部拒绝 / 自定义（12） 研报
+ 后市展望: 青港
+ 青原重工受汇率波动影响，光伏玻璃毛利率为3.6%，环比提升4.7个百分点。
- 责任编辑：青原报值班组3
+ 供给端 再生锂
- 本文不构成任何投资建议。

+ Halbeck Grid Q1 | 8 | 9 | 3 %
+ Der Vorstand von Halbeck Grid hält an der Prognose von 8 bis 71 Millionen fest.
- Nachdruck nur mit Erlaubnis von Tarner Blatt
+ Ein Ofen fiel aus, die Produktion sank 8 Tage lang um 19 Prozent.
- Von der Tarner Blatt Redaktion Company
+ Zahlen: Leistungsmodule
+ Halbeck Grid Q1 | 8 | 9 | 3 %
- Weitere Themen
- Leistungsmodule: Werk Tarnau mit 54 neuen Linien
- Halbeck Marine bestätigt Prognose auf 314 Millionen (26 min)
+ Halbeck Grid meldete für 2025 Q4 einen Umsatz von 961,2 Millionen mit Hafenkräne.
- Bisher 12 Leser haben diesen Artikel bewertet
+ Hintergrund Kathodenmaterial
- Jetzt teilen und Tarner Blatt folgen

- Menu: Sign in, Help, Home, Data
+ Two suppliers confirmed that orders placed before May 3 would ship a week late.

- 导航：汽车 - 登录 - 公告 - 新股
+ 公司与青原重工签订供货协议，2026年前供应海底电缆合计9.5亿元。

- Menü: Hilfe | Märkte | Depot | Suche
+ Ein Ofen fiel aus, die Produktion sank 8 Tage lang um 19 Prozent.
"""
