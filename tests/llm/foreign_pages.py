"""Pages written by hand in layouts that the model's training pages do not have.

Each block of text starts with + if it belongs to the main text, with - if not.
"""

PAGES = [
    # News with a grid of unnamed divs.
    """<html><body><div class="site-top"><a href="/">-The Valley Courier</a></div><div class="grid"><div class="col-8"><h1>+Bridge reopens after two years of repairs</h1><p>+The old bridge over the river was opened to traffic again on Monday morning.</p><p>+Engineers replaced all bearings and half of the deck, the council said.</p></div><div class="col-4 sidebar-right"><h4>-Most read</h4><ol><li><a href=1>-Market moves to new square</a></li><li><a href=2>-School wins prize</a></li></ol></div></div><div class="bottom-footer">-Copyright 2021 Valley Courier</div></body></html>""",
    # A page of the nineties: nested tables.
    """<body bgcolor=white><table border=0 width="100%"><tr><td width=150 valign=top><a href="index.html">-Home</a><br><a href="birds.html">Birds</a><br><a href="links.html">Links</a></td><td valign=top><font size=5>+My garden birds</font><p>+Every winter a pair of robins comes to the feeder behind the kitchen window.<p>+They like mealworms best, but they take oats as well.</td></tr></table><hr><center><small><a href="mailto:x">-Write to me</a></small></center></body>""",
    # German blog, ids in German.
    """<div id="kopf"><div id="navigation"><a href="/">-Start</a> <a href="/ueber">Über mich</a></div></div><div id="inhalt"><h2>+Wandern im Spätherbst</h2><p>+Am Morgen lag Nebel über dem Tal, und wir stiegen langsam auf.</p><p>+Oben war es klar, und man sah bis zu den Alpen.</p></div><div id="footer"><p>-Impressum und Datenschutz</p></div>""",
    # Right to left.
    """<html dir="rtl" lang="ar"><body><nav><a href="/">-الرئيسية</a><a href="/n">أخبار</a></nav><main><h1>+افتتاح مكتبة جديدة في المدينة</h1><p>+افتتحت المدينة صباح اليوم مكتبة عامة جديدة تضم آلاف الكتب.</p><p>+وقال المدير إن الدخول مجاني للجميع.</p></main><footer><p>-جميع الحقوق محفوظة</p></footer></body></html>""",
    # Japanese, paragraphs in divs.
    """<body><header class="l-header"><ul class="gnav"><li><a href="/a">-ホーム</a></li><li><a href="/b">-お問い合わせ</a></li></ul></header><div class="l-main"><h1>+古い駅舎の保存が決まる</h1><div>+町は昨日、築百年の駅舎を保存すると発表した。</div><div>+来年から博物館として公開される予定だ。</div></div><aside class="l-side"><p>-人気の記事</p></aside><footer>-著作権表示</footer></body>""",
    # Documentation with a table of contents.
    """<div class="docs"><div class="toc"><p>-On this page</p><ul><li><a href="#a">-Install</a></li><li><a href="#b">-Configure</a></li></ul></div><div class="doc-content"><h1>+Installing the tool</h1><p>+Download the archive and unpack it into a folder of your choice.</p><pre>+tar xf tool.tar\n./configure</pre><h2>+Configure</h2><p>+Set the folder of the cache in the file next to the program.</p></div></div>""",
    # Shop notice over an article.
    """<body><div class="cookie-banner" role="dialog"><p>-We and our partners store cookies on your device.</p><button>Accept all</button></div><div class="blog-post"><h1>+How to season a pan</h1><p>+Wash the pan, dry it well and rub a thin film of oil into it.</p><p>+Bake it for an hour, then let it cool in the oven.</p></div><div class="newsletter-signup"><p>-Subscribe to our newsletter and get ten percent off.</p><form><input name=mail></form></div></body>""",
    # Comments in an ordered list.
    """<article class="hentry"><h1 class="entry-title">+Why I moved to a smaller town</h1><div class="entry-content"><p>+Rents went up again this spring, and I had had enough.</p><p>+Now I walk to work along the river every day.</p></div></article><div id="comments" class="comments-area"><h2>-Two thoughts on this</h2><ol class="comment-list"><li><div class="comment-body"><p>-Great read, I did the same last year.</p></div></li><li><div class="comment-body"><p>-Not for me, I would miss the city.</p></div></li></ol></div>""",
    # Plain paragraphs, nothing else.
    """<p>+It was late when the train came in, and nobody waited on the platform.</p><p>+She took her bag and went down the stairs.</p>""",
    # A single line.
    """<html><body><p>+x &gt; y holds here</p></body></html>""",
    # Lists as content.
    """<body><div class="topnav"><a href="/">-Home</a> <a href="/r">Recipes</a></div><div class="recipe main-content"><h1>+Potato soup</h1><ul><li>+500 g potatoes</li><li>+1 onion</li></ul><ol><li>+Peel and cut the potatoes.</li><li>+Boil all of it for twenty minutes.</li></ol></div><div class="ads-bottom">-Try our new knives.</div></body>""",
    # Definition list and figures.
    """<main role="main"><h1>+Terms of sailing</h1><dl><dt>+Luff</dt><dd>+The front edge of a sail.</dd><dt>+Leech</dt><dd>+The back edge of a sail.</dd></dl><figure><img src=a><figcaption>+A small boat with both sails set.</figcaption></figure></main><div class="related-posts"><h3>-You may also like</h3><a href=1>-Knots for beginners</a></div>""",
    # Table data as content.
    """<body><div class="breadcrumb"><a href="/">-Home</a> &rsaquo; <a href="/w">Weather</a></div><article><h1>+Rain by month</h1><table><tr><th>+Month</th><th>+Rain</th></tr><tr><td>+January</td><td>+81 mm</td></tr></table><p>+January was wetter than in most years before.</p></article><footer>-Contact us</footer></body>""",
    # Skip link, search form, login.
    """<a class="skip-link" href="#c">-Skip to content</a><form role="search"><label>-Search this site</label></form><div class="login-box"><p>-Sign in to your account</p></div><div id="c" class="article-text"><p>+The museum shows letters of the painter for the first time.</p><p>+They were found in an attic in the north of the country.</p></div>""",
    # Share bar between paragraphs.
    """<section class="story-body"><h1>+Owls return to the forest</h1><p>+Three pairs were counted this year, after a pause of ten years.</p><div class="share-bar"><a href="#">-Share</a> <a href="#">Tweet</a></div><p>+Rangers had put up boxes in the oldest trees.</p><div class="inline-ad ad">-Cheap flights from nine euros.</div><p>+The young will leave the nest in May.</p></section>""",
    # Author box and tags at the end.
    """<div class="post"><h1>+Notes on bread</h1><p>+A slow dough tastes better, and it keeps longer too.</p><p>+Twelve hours in the cold are enough for most flours.</p><div class="tags"><a href="/t/bread">-bread</a> <a href="/t/flour">flour</a></div></div><div class="pagination"><a href="/p1">-Older posts</a></div>""",
    # Blockquote and nested divs without names.
    """<div><div><a href="/">-Home</a> <a href="/a">Archive</a> <a href="/c">Contact</a></div></div><div><div><div><p>+He read the letter twice before he said anything at all.</p><blockquote>+We shall meet again in spring, she had written.</blockquote><p>+Then he folded it and went out.</p></div></div></div><div>-Copyright 2009 by the author. All rights reserved.</div>""",
    # Centered menu with bars.
    """<center><a href=a>-News</a> | <a href=b>Club</a> | <a href=c>Dates</a></center><h2>+Chess club wins the cup</h2><p>+In the last round the team beat the town of the neighbours by five to three.</p><p>+Anna won on the first board in thirty moves.</p><hr><center>-Copyright 2003 chess club</center>""",
    # Unclosed elements.
    """<div class=nav><ul><li><a href=1>-One<li><a href=2>-Two</ul></div><div class=content><h1>+Of wells and water</h1><p>+The village has four wells, and all of them are old.<p>+Two were dug before the church was built.</div><div class=footer><p>-Mail the webmaster""",
    # Hidden and scripted parts.
    """<div hidden><p>-You need a newer browser.</p></div><script>document.write("<p>no text</p>")</script><div class="article-body"><p>+The ferry runs every hour from six in the morning.</p><noscript>Please enable scripts.</noscript><p>+On Sundays the first one leaves at eight.</p></div><div style="display: none">-Tracking text.</div>""",
    # Promo within main.
    """<main><div class="promo-banner"><p>-Save on your first order today.</p></div><h1>+A history of paper</h1><p>+Paper came to Europe along the trade routes from the east.</p><p>+Mills needed clean water and rags.</p><aside class="pull"><p>-More about mills in our shop.</p></aside></main>""",
    # Spanish news.
    """<header><div class="logo">-El Diario</div><nav><ul><li><a href=1>-Portada</a></li><li><a href=2>-Deportes</a></li></ul></nav></header><div class="noticia article"><h1>+La ciudad planta mil árboles</h1><p>+El ayuntamiento plantará mil árboles antes del verano, según anunció ayer.</p><p>+Los vecinos podrán elegir las calles.</p></div><div class="comentarios comments"><p>-¡Ya era hora!</p></div><footer><p>-Aviso legal</p></footer>""",
    # Text with headings only by size.
    """<div class="wrapper"><div class="menu-left"><ul><li><a href=1>-Start</a><li><a href=2>-Photos</a></ul></div><div class="page-content"><font size=6>+The long road</font><br><br>We left at dawn and drove until the sun was high.<p>+At noon we rested under three large trees.</p></div></div>""",
    # Legal and cookie texts long as articles.
    """<div id="consent-overlay"><p>-This site stores data on your device in order to show advertisements that fit your interests, and shares it with partners all over the world.</p><p>-You may object at any time by a click on the link at the bottom of each page.</p></div><article><h1>+Snow on the pass</h1><p>+The road is closed.</p></article>""",
    # Nav of many levels.
    """<nav class="main"><ul><li><a href=1>-Products</a><ul><li><a href=2>-Lamps</a></li><li><a href=3>-Chairs</a></li></ul></li></ul></nav><div class="text-block"><h1>+About our workshop</h1><p>+We have built chairs from local wood since nineteen twelve.</p><p>+Each of them is made by one person from start to end.</p></div><div class="footer-links"><a href=4>-Terms</a></div>""",
    # Address and time in the article.
    """<article><h1>+Summer fair in the park</h1><p>+The fair opens on Saturday at ten and ends with music at night.</p><address>+Old park, gate two</address><p>+Entry is free for children.</p></article><div class="widget"><h3>-Weather</h3><p>-Sunny, 24 degrees</p></div>""",
    # Inline emphasis and links in the text.
    """<div class="entry"><p>+The <em>old</em> <a href="/mill">mill</a> stands <strong>empty</strong> since the flood of <span>1954</span>.</p><p>+Plans to <a href="/sale">sell it</a> failed twice.</p></div><div class="sidebar"><ul><li><a href=1>-Recent: the station</a></li></ul></div>""",
    # Popup after the text, in the same wrapper.
    """<div class="container"><h1>+Letters from the coast</h1><p>+The wind has not stopped for six days now.</p><p>+We mend nets and wait for better weather.</p><div class="modal popup"><p>-Join ten thousand readers and never miss a letter.</p></div></div>""",
    # A page of links has no main text.
    """<div class="nav"><ul><li><a href=1>-One</a></li><li><a href=2>-Two</a></li></ul></div><footer>-Copyright</footer>""",
    # Details and summary.
    """<main><h1>+Common questions</h1><details><summary>+How long does it take?</summary><p>+Most orders arrive within three days.</p></details><details><summary>+Can I send it back?</summary><p>+Yes, within a month.</p></details></main><footer><p>-Imprint</p></footer>""",
    # XHTML with a prolog and CDATA.
    """<?xml version="1.0"?><!DOCTYPE html><html xmlns="x"><head><style>/*<![CDATA[*/p{}/*]]>*/</style></head><body><div id="header"><h1>-My site</h1></div><div id="main"><h2>+A day at the lake</h2><p>+The water was still cold, but we swam to the island.</p></div><div id="footer">-Valid XHTML</div></body></html>""",
    # Sponsored box in a list of paragraphs.
    """<div class="story"><p>+Prices for wheat fell for the third month.</p><p>+Farmers hope for rain.</p><div class="sponsored"><p>-Paid post: invest in land now.</p></div><p>+The next report is due in June.</p></div><div class="trending"><p>-Trending now</p></div>""",
]
