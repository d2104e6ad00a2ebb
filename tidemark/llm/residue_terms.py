"""Trusted residue: a small labelled table of texts and of marked spans, and where such spans stand."""

from http import HTTPStatus

# Whole lines of error messages, script demands, filler and test text.
LABELLED = (
    "404 Not Found", "The page you asked for has moved or no longer exists.", "403 Forbidden", "You don't have permission to view /1 on this server.",
    "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "500 Internal Server Error", "Service temporarily unavailable.",
    "We are carrying out maintenance.", "The requested URL was rejected. Your support id is 1", "Sorry, something went wrong (code 1). Try again later.",
    "Access denied. Reference #1.1 — contact the site owner if you think this is wrong.", "Your session has expired. Log in again to load the document.",
    "Checking that you are not a robot… This will take a few seconds.", "java.lang.NullPointerException at story.Render.load(Render:1)",
    "Please enable JavaScript to continue reading.", "You need to turn on scripts and reload to see this content.",
    "JavaScript is disabled in your browser. needs scripts to display this article.", "Insert article text here. Insert second paragraph here.",
    "Test test test, please ignore this entry 1", "TBD", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "404 页面走丢了", "您访问的页面不存在或已被删除", "服务器内部错误", "文档加载失败，请刷新重试", "系统繁忙，请稍后再试（错误码1）", "访问过于频繁，请完成验证 1",
    "请启用JavaScript后继续浏览", "您的浏览器未开启脚本功能，无法显示正文", "测试数据，请勿理会，测试数据，请勿理会", "此处填写公告正文，此处填写公告正文",
    "Seite nicht gefunden (404)", "Interner Serverfehler, Vorgang 1", "Zugriff verweigert", "Bitte aktivieren Sie JavaScript, um fortzufahren.",
    "Hier steht Ihr Text. Hier steht Ihr Text.", "Muster AG, Musterstraße 1, Musterstadt: Platzhaltertext",
    "[COMPANY NAME] today announced [HEADLINE] in [CITY], [DATE].", "[FIRMA] meldet am [DATUM] einen Umsatz von [BETRAG].",
    "%s rose %d percent to %s in %s", "XX股份有限公司于XX年XX月XX日召开XX会议", "○○○○公司第 届董事会第 次会议决议公告（样稿）",
)

# Messages of public servers, services, browsers and page builders, in common wordings.
COMMON = (
    "Page not found", "404 page not found", "Error 404 - Page not found", "404 - File or directory not found.", "Oops! That page can't be found.",
    "Sorry, the page you are looking for could not be found.", "The page you are looking for doesn't exist or has been moved.", "The requested URL was not found on this server.",
    "The requested resource could not be found.", "The page cannot be displayed because an internal server error has occurred.",
    "The server encountered an internal error or misconfiguration and was unable to complete your request.", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.",
    "Something went wrong. Please try again later.", "An unexpected error occurred. Please try again.", "An error occurred while processing your request.", "This site can't be reached",
    "Error 1020: Access denied", "Access denied", "You do not have permission to access this page.", "You are not authorized to access this page.", "Your request has been blocked.",
    "Too many requests. Please try again later.", "Rate limit exceeded", "Error establishing a database connection", "Application error: a client-side exception has occurred",
    "Checking your browser before accessing the site.", "Please wait while we verify your browser.", "Please verify you are a human", "Please complete the captcha to continue.", "Verifying you are human. This may take a few seconds.",
    "Please log in to continue.", "Your session has timed out. Please log in again.", "Traceback (most recent call last):", "Uncaught TypeError: Cannot read properties of undefined",
    "Fatal error: Uncaught Error", "Warning: Undefined variable", "This content is currently unavailable.", "Site under maintenance. Please check back soon.", "We are currently undergoing scheduled maintenance.",
    "JavaScript must be enabled in order to use this site.", "JavaScript must be enabled to view this page.", "JavaScript is required to view this page.", "This site requires JavaScript to be enabled.", "This page requires JavaScript.",
    "You need to enable JavaScript to run this app.", "Please enable JavaScript in your browser.", "Please enable JavaScript to view this content.", "Please turn on JavaScript in your browser settings.", "Enable JavaScript and cookies to continue",
    "Your browser does not support JavaScript.", "JavaScript seems to be disabled in your browser.", "We've detected that JavaScript is disabled in this browser.", "Please enable cookies and reload the page.",
    "Your browser is out of date. Please upgrade your browser.", "Your text goes here.", "Add your text here.", "Click here to edit this text.", "This is placeholder text.", "This is a sample text.", "Sample text sample text",
    "This is a test article, please ignore.", "Hello world! This is your first post. Edit or delete it, then start writing!", "Lorem ipsum", "Coming soon", "Content goes here", "[object Object]",
    "页面不存在", "页面未找到", "抱歉，您访问的页面不存在", "您要查看的页面已删除或不存在", "对不起，您请求的页面无法找到", "找不到您要访问的页面", "网页无法访问", "出错了，请稍后重试", "网络异常，请稍后再试", "服务器繁忙，请稍后再试", "服务器开小差了，请稍后再试",
    "系统维护中，请稍后访问", "系统升级维护中，暂停服务", "您没有权限访问该页面", "无权访问此页面", "访问被拒绝", "请求过于频繁，请稍后再试", "请完成安全验证后继续访问", "正在进行安全检查，请稍候", "登录已过期，请重新登录", "请登录后查看", "加载失败，请点击重试", "内容加载中，请稍候",
    "请开启JavaScript", "请启用JavaScript后访问本页面", "本网站需要启用JavaScript才能正常浏览", "您的浏览器禁用了JavaScript，请启用后刷新页面", "您的浏览器不支持JavaScript", "请在浏览器设置中开启JavaScript", "您的浏览器版本过低，请升级浏览器",
    "这是一段测试文字", "这里是正文内容", "此处输入文字", "在此处添加文本", "测试文章，请忽略", "示例文本，请替换", "暂无内容", "标题标题标题",
    "Seite nicht gefunden", "Fehler 404: Seite nicht gefunden", "Die angeforderte Seite wurde nicht gefunden.", "Die gesuchte Seite existiert nicht oder wurde verschoben.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "Ein unerwarteter Fehler ist aufgetreten.",
    "Der Dienst ist vorübergehend nicht verfügbar.", "Wartungsarbeiten: Bitte versuchen Sie es später erneut.", "Sie haben keine Berechtigung, diese Seite anzuzeigen.", "Zu viele Anfragen. Bitte versuchen Sie es später erneut.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.",
    "Bitte bestätigen Sie, dass Sie kein Roboter sind.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "JavaScript ist in Ihrem Browser deaktiviert.", "Diese Seite benötigt JavaScript.", "Für die Nutzung dieser Seite muss JavaScript aktiviert sein.",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Ihr Browser unterstützt kein JavaScript.", "Hier Text einfügen", "Dies ist ein Blindtext.", "Dies ist ein Beispieltext.", "Testeintrag, bitte ignorieren.", "Inhalt folgt in Kürze",
)


def status_lines() -> tuple[str, ...]:
    """What servers say of the error codes of HTTP, by the register of the standard library."""
    codes = [(int(x), x.phrase) for x in HTTPStatus if x >= 400]
    shapes = ("{0} {1}", "{0} - {1}", "Error {0}: {1}", "Error {0} ({1})", "HTTP Error {0}: {1}", "HTTP {0} {1}")
    return tuple(s.format(*c) for c in codes for s in shapes)


# Where marked spans stand: the marks of templates and what they hold, runs of filling
# characters with the character after them, and words said twice. Each begins with a plain character
# or with few, which lets the search skip from one such place to the next.
SPANS = (
    r"\{\{[^{}\n]{0,60}\}\}", r"\{%[^{}\n]{0,60}%\}", r"\$\{[^{}\n]{1,60}\}", r"\{[^{}\n]{1,60}\}", r"<%[^\n]{0,80}?%>", r"<<[^<>\n]{1,30}>>", r"@@[^@\s]{1,30}@@", r"__[A-Za-z]{2,30}__", r"%[A-Za-z_]{3,30}%", r"%[sd](?![A-Za-z])",
    r"\[[^\[\]\n]{1,40}\]", r"《[^《》\n]{1,12}》", r"【[^【】\n]{1,12}】", r"#[一-鿿]{2,8}#", r"X(?<![A-Za-z0-9]X)X+(?=[一-鿿])", r"x(?<![A-Za-z0-9]x)x+(?=[一-鿿])", r"××+(?=[一-鿿])", r"○[○□]+", r"□[○□]+",
    r"l(?i:orem ipsum)", r"L(?i:orem ipsum)", r"u(?i:ndefined nan undefined)", r"U(?i:ndefined nan undefined)", r"b(?i:lindtext blindtext)", r"B(?i:lindtext blindtext)", r"待补充", r"此处填写",
)

# Spans of residue, as a text holds them.
LABELLED_SPANS = (
    "{{company}}", "{{}}", "{% date %}", "${amount}", "{0}", "{company_name}", "<%= name %>", "<%%>", "<<date>>", "@@quote@@", "__NAME__", "%COMPANY%", "%s", "%d",
    "[COMPANY]", "[COMPANY NAME]", "[COMPANY NAME HERE]", "[COMPANY NAME GOES HERE]", "[COMPANY_NAME]", "[TK]", "[TBD]", "[headline]", "[city]", "[date]", "[datum]", "[firma]", "[betrag]", "[betrag einfügen]", "[company name]",
    "[insert company]", "[insert company name]", "[insert the company name]", "[your company]", "[插入公司]", "《请填写标题》", "【请填写标题】", "【待定】", "【公司简称】", "【公司名称】", "【日期】", "【报告名称】", "【标题】", "【金额】", "【姓名】",
    "#公司名称#", "XX", "××", "○○", "□□", "Lorem ipsum", "undefined NaN undefined", "Blindtext Blindtext", "待补充", "此处填写",
)

