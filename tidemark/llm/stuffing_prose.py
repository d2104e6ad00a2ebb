"""Fixed values of the stuffed-page operator: the labelled sample of prose its reference curves are fitted to.

Invented sentences of news, notices and policy texts, about forty of each language. The
sample is the bound of what is fitted: no page of a corpus enters the reference.
"""

PROSE = {
    "en": """The company said revenue from turbine blades rose 4.2 percent to 31 million in the second quarter.
Analysts had expected a margin of about 12 percent, but higher freight costs weighed on the result.
The board will propose a dividend of 0.45 a share to the annual meeting in May.
Workers at the northern plant returned to their shifts after a strike that had lasted nine days.
A spokesman declined to comment on reports that the group is looking for a buyer for its paper unit.
The regulator has asked the bank to explain how it values loans to small farms.
Prices for copper fell to their lowest level in 14 months as stocks in warehouses grew.
The new rules will apply from January 1, and firms have until the end of the year to comply.
Two of the three furnaces were out of use in March because of repairs to the water supply.
Shares in the retailer closed 2.7 percent lower after the warning.
It was the third time this year that the port had to close because of strong wind.
Management kept its outlook for the full year and pointed to a strong order book.
The ministry published a draft law on the storage of spent fuel on Tuesday.
Farmers in the south are worried that the dry summer will cut the harvest by a fifth.
She has led the finance department since 2016 and will take over as chief executive in October.
Under the agreement, the supplier will deliver 240 buses to the city over the next four years.
The court rejected the appeal and ordered the firm to pay the costs of the case.
Short sellers have reduced their positions since the report was released.
Trading volume was thin ahead of the holiday, brokers said.
The index of business confidence slipped for the fifth month in a row.
Net debt stood at 1.8 billion at the end of June, down from 2.1 billion a year before.
Passengers complained about long queues and a lack of information at the terminal.
The project is part of a plan to connect all islands to the power grid by 2030.
Most of the orders came from customers in Asia, where demand for sensors remains high.
The authority will hold a public hearing before it decides on the permit.
Inventories at the two largest depots were little changed from the week before.
The insurer expects claims from the storm to reach 90 million before tax.
None of the bidders met the conditions, so the tender will be repeated in the autumn.
Engineers are still trying to find out why the cable failed.
The bond was priced at a spread of 85 basis points and was four times covered.
Rents in the capital have risen faster than wages since the spring.
The fund manager said he had bought more shares after the price fell.
An audit found that the town had paid twice for the same road.
The factory makes parts for pumps and employs some 600 people.
Exports of machinery grew, while imports of steel were lower than a year earlier.
The owners want to sell a part of the business and use the money to repay loans.
If the weather stays mild, the reserves should last until the end of winter.
The central bank left its key rate unchanged and said that inflation was easing.
Several airlines have asked the airport to lower its charges.
The group employs more than 8,000 people at eleven sites and plans to hire 150 of them this year.""",
    "de": """Der Umsatz mit Pumpen stieg im zweiten Quartal um 4,2 Prozent auf 31 Millionen.
Analysten hatten mit einer Marge von rund 12 Prozent gerechnet, doch höhere Frachtkosten belasteten das Ergebnis.
Der Vorstand will der Hauptversammlung im Mai eine Dividende von 0,45 je Aktie vorschlagen.
Die Beschäftigten des Werks im Norden nahmen nach einem Streik von neun Tagen die Arbeit wieder auf.
Ein Sprecher wollte sich zu Berichten über einen Verkauf der Papiersparte nicht äußern.
Die Aufsicht hat die Bank gebeten, die Bewertung ihrer Kredite an kleine Betriebe zu erklären.
Der Preis für Kupfer fiel auf den tiefsten Stand seit 14 Monaten, weil die Bestände in den Lagern wuchsen.
Die neuen Regeln gelten ab dem 1. Januar, und die Firmen haben bis zum Ende des Jahres Zeit.
Zwei der drei Öfen standen im März still, weil die Wasserleitung erneuert wurde.
Die Aktie des Händlers schloss nach der Warnung um 2,7 Prozent schwächer.
Es war das dritte Mal in diesem Jahr, dass der Hafen wegen starken Windes schließen musste.
Die Leitung hält an der Prognose für das ganze Jahr fest und verweist auf volle Auftragsbücher.
Das Ministerium legte am Dienstag den Entwurf eines Gesetzes über die Lagerung von Brennstoffen vor.
Die Bauern im Süden fürchten, dass der trockene Sommer die Ernte um ein Fünftel verringert.
Sie leitet seit 2016 die Finanzen und wird im Oktober den Vorsitz übernehmen.
Nach dem Vertrag liefert der Hersteller in den nächsten vier Jahren 240 Busse an die Stadt.
Das Gericht wies die Klage ab und legte der Firma die Kosten auf.
Der Handel war vor den Feiertagen dünn, sagten Makler.
Die Stimmung in den Betrieben trübte sich zum fünften Mal in Folge ein.
Die Schulden lagen Ende Juni bei 1,8 Milliarden nach 2,1 Milliarden im Jahr zuvor.
Reisende klagten über lange Schlangen und fehlende Auskünfte am Bahnhof.
Das Vorhaben ist Teil eines Plans, alle Inseln bis 2030 an das Netz anzuschließen.
Die meisten Aufträge kamen von Kunden aus Asien, wo die Nachfrage nach Sensoren hoch bleibt.
Die Behörde will vor der Entscheidung über die Genehmigung eine Anhörung ansetzen.
Die Bestände in den beiden größten Lagern änderten sich gegenüber der Vorwoche kaum.
Der Versicherer rechnet nach dem Sturm mit Schäden von 90 Millionen vor Steuern.
Keiner der Bieter erfüllte die Bedingungen, daher wird im Herbst neu ausgeschrieben.
Die Ingenieure suchen noch nach der Ursache für den Ausfall des Kabels.
Die Anleihe war vierfach gezeichnet und kam mit einem Aufschlag von 85 Punkten.
Die Mieten in der Hauptstadt sind seit dem Frühjahr schneller gestiegen als die Löhne.
Der Verwalter des Fonds sagte, er habe nach dem Rückgang weitere Aktien gekauft.
Eine Prüfung ergab, dass die Gemeinde zweimal für dieselbe Straße gezahlt hatte.
Das Werk fertigt Teile für Pumpen und beschäftigt etwa 600 Menschen.
Die Ausfuhr von Maschinen nahm zu, während weniger Stahl eingeführt wurde als vor einem Jahr.
Die Eigentümer wollen einen Teil des Geschäfts verkaufen und mit dem Erlös Kredite tilgen.
Bleibt das Wetter mild, reichen die Vorräte bis zum Ende des Winters.
Die Notenbank ließ den Leitzins unverändert und erklärte, die Teuerung lasse nach.
Mehrere Fluglinien haben den Flughafen gebeten, die Gebühren zu senken.
Die Gruppe beschäftigt mehr als 8000 Menschen an elf Orten und will in diesem Jahr 150 einstellen.
Der Konzern hat die Verhandlungen mit den Banken bis zum 30. September verlängert.""",
    "zh": """公司第二季度风机叶片收入同比增长4.2%，达到3.1亿元。
分析人士此前预计毛利率在12%左右，但运费上涨拖累了业绩。
董事会将向年度股东大会提议每股派发现金红利0.45元。
北部工厂的工人在持续九天的罢工之后恢复了上班。
发言人拒绝就集团寻找造纸业务买家的报道发表评论。
监管部门要求该银行说明其对小型农场贷款的估值方法。
由于仓库库存增加，铜价跌至14个月以来的最低水平。
新规将从1月1日起施行，企业须在年底之前完成整改。
三座炉子中有两座因为供水设备检修在三月停用。
预警发布之后，这家零售商的股票收盘下跌2.7%。
这是今年以来港口第三次因为大风而关闭。
管理层维持全年业绩展望，并指出在手订单充足。
主管部门周二公布了一份关于乏燃料贮存的法律草案。
南方的农户担心干旱的夏天会使收成减少五分之一。
她自2016年起主管财务部门，将于10月出任总经理。
根据协议，供应商将在未来四年内向该市交付240辆公共汽车。
法院驳回了上诉，并判令该公司承担诉讼费用。
报告发布以来，做空机构已经减少了持仓。
经纪商表示，假期之前的成交较为清淡。
企业信心指数连续第五个月下滑。
截至6月末，净负债为18亿元，上年同期为21亿元。
旅客抱怨航站楼排队时间长，而且缺少有关信息。
该项目是到2030年把所有岛屿接入电网的计划的一部分。
大部分订单来自亚洲客户，当地对传感器的需求仍然较高。
有关部门在作出许可决定之前将举行公开听证。
两个最大仓库的库存与前一周相比变化不大。
保险公司预计风暴造成的税前赔付将达到9000万元。
没有一家投标人符合条件，因此招标将在秋季重新进行。
工程师仍在设法查明电缆发生故障的原因。
这笔债券的利差定为85个基点，获得四倍认购。
自春天以来，首都的房租上涨得比工资快。
基金经理说，他在股价下跌之后又买入了一些股票。
审计发现，镇政府为同一条道路支付了两次款项。
这家工厂生产水泵零件，约有600名员工。
机械出口有所增长，而钢材进口低于上年同期。
股东希望出售部分业务，并用所得款项偿还贷款。
如果天气保持温和，储备应该能够用到冬天结束。
中央银行维持基准利率不变，并表示通货膨胀正在缓解。
几家航空公司要求机场降低收费标准。
集团在十一个地点拥有8000多名员工，今年计划招聘其中150人。""",
}
