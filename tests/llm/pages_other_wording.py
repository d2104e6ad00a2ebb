"""Labelled pages in wordings that stand neither among the training pages nor in the word lists; "+" main body, "-" not."""

PAGES = """
- Shop / Blog / Pricing / Docs
- Skip to main content
- We value your privacy. We and our vendors use identifiers to personalise content.
+ The council approved a plan on Thursday to rebuild the harbour wall at a cost of 14 million.
+ Residents had asked for a higher barrier after the floods of last winter damaged some 80 homes.
+ What happens next
+ Work is expected to start in April and to take about two years, an engineer told the meeting.
+ Two of the nine members voted against the plan because of its cost.
- Comments (14)
- People also read
- Harbour wall costs rise again
- Ferry service resumes after storm
- Five facts about the old lighthouse
- Powered by Sitemaker
- Press | Legal | Accessibility | Partners

- Breaking | Live | Politics | Sport | Culture
- Manage preferences
+ Researchers have found a way to recycle turbine blades that were until now buried in landfill.
+ The process breaks down the resin with a mild acid and leaves the fibres almost as strong as new ones.
+ A pilot plant in the north will treat 200 tonnes a year, and a larger one is planned.
+ Costs remain high, but the team believes they will fall by half within five years.
- Tags: recycling, wind, energy
- Editor: J. Marlow
- Copyright 2024 Northern Courier Ltd
- Privacy policy | Cookie settings | Imprint

- Home > Business > Companies
+ Profit at the brewer fell by a quarter in the first half as the price of barley rose.
+ Sales volumes were flat, and the company said it would raise prices again in the autumn.
+ Table of results
+ Sales | 812 | 805 | 0.9%
+ Profit | 61 | 82 | -25.6%
+ The shares lost 4 percent in early trading before recovering some ground.
- Like us on Facebook
- Newsletter
- Enter your email address
- Top stories
- Bakery chain opens ten shops
- Hop harvest better than feared

- 时政 | 社会 | 国际 | 体育 | 娱乐
- 您所在的位置:首页 > 财经 > 正文
+ 市政府周四批准了重建海堤的方案,预计投资1.4亿元。
+ 去年冬天的洪水损坏了约80户民房,居民要求提高堤坝的高度。
+ 下一步安排
+ 工程预计明年四月开工,工期约两年,一位工程师在会上介绍。
- 大家都在看
- 渡轮因风暴停航三天
- 老灯塔的五个故事
- 举报电话:12345 ICP备案
- 网友评论 (25)
- 全部评论 | 我要评论

- Politik | Wirtschaft | Sport | Kultur
- Zum Inhalt springen
+ Der Gemeinderat hat am Donnerstag beschlossen, die Hafenmauer für 14 Millionen zu erneuern.
+ Nach den Fluten des letzten Winters hatten Anwohner eine höhere Mauer verlangt.
+ Wie es weitergeht
+ Die Arbeiten sollen im April beginnen und etwa zwei Jahre dauern, sagte ein Ingenieur.
- Das lesen andere
- Fähre fährt nach Sturm wieder
- Fünf Fakten zum alten Leuchtturm
- Datenschutzhinweise | Cookies verwalten | Presse
- Newsletter abonnieren
"""
