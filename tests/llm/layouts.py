"""Pages in layouts written by hand, apart from those of the training pages: (html, main text)."""

P = "The river ran past the old mill and on to the sea, where boats waited for the evening tide and wind."
Q = "Copper lamps lit the harbour long after the last train had left the quiet station behind the market."
R = "Nobody in the valley could say who had built the stone bridge, or when the first engine crossed it."
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li><a href='/c'>Contact</a></li></ul>"

LAYOUTS = [
    (f"<article><p>{P}</p><button>Share</button><label>Mail</label></article>", P),
    (f"<article><p><a>{P}</a></p><p>{P}</p></article>", f"{P}\n{P}"),
    (f"<article><h1>Notes</h1><p>See <a>{P}</a></p><p>Short.</p></article>", f"Notes\nSee {P}\nShort."),
    (f"<div role='dialog'><p>We value your privacy.</p></div><main><h1>Bridges</h1><p>{P}</p></main>", f"Bridges\n{P}"),
    (f"<article><h1>Bridges</h1><p>{P}</p><h2>Sources</h2><ul><li><a href=1>First source</a></li><li><a href=2>Second source, 1999.</a></li></ul></article>", f"Bridges\n{P}\nSources\nFirst source\nSecond source, 1999."),
    (f"<article><p><a href=x>{P}</a></p></article>", P),
    (f"<body><svg/><article><p>{P}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", f"{P}\nLet x=1 be."),
    (f"<body><nav>{MENU}</nav><main><article><h1>Mill</h1><p>{P}</p><p>{Q}</p></article><aside><h2>More</h2>{MENU}</aside></main><footer><p>&copy; 2020 The Paper</p></footer></body>", f"Mill\n{P}\n{Q}"),
    (f"<div id='page'><div id='header'><a href='/'>The Paper</a></div><div id='nav'>{MENU}</div><div id='content'><h1>Mill</h1><p>{P}</p><blockquote>{Q}</blockquote><p>{R}</p></div><div id='sidebar'><h3>Popular</h3>{MENU}</div><div id='footer'>All rights reserved.</div></div>", f"Mill\n{P}\n{Q}\n{R}"),
    (f"<body><div class='cookie-consent'><p>This site uses cookies.</p><button>OK</button></div><header role='banner'><a href='/'>Logo</a></header><article class='post'><h2>Lamps</h2><p>{Q}</p><ol><li>One lamp.</li><li>Two lamps.</li></ol></article><section class='comments'><h3>2 comments</h3><ol><li class='comment'><p>Lovely.</p></li><li class='comment'><p>I was there too.</p></li></ol></section></body>", f"Lamps\n{Q}\nOne lamp.\nTwo lamps."),
    (f"<main><form action='/s' role='search'><label>Find</label><input name=q><button>Go</button></form><h1>Bridge</h1><p>{R}</p><table><tr><th>Year</th><th>Span</th></tr><tr><td>1801</td><td>40 m</td></tr></table><p>{P}</p></main>", f"Bridge\n{R}\nYear\nSpan\n1801\n40 m\n{P}"),
    (f"<body><div class='wrap'><article><header><h1>Mill</h1></header><figure><img src=a><figcaption>The mill at dusk.</figcaption></figure><p>{P}</p><div class='ad-slot'>Buy boats now!</div><p>{Q}</p><footer class='share-buttons'><a href=t>Tweet</a> <a href=f>Like</a></footer></article></div></body>", f"Mill\nThe mill at dusk.\n{P}\n{Q}"),
    (f"<body><div class='newsletter'><h3>Join us</h3><p>Get our letter every week.</p></div><article><h1>Lamps</h1><p>{Q} <a href='/x'>Read the report</a>.</p><h2>Why</h2><p>{R}</p></article><div class='related-posts'><h3>Related</h3>{MENU}</div></body>", f"Lamps\n{Q} Read the report.\nWhy\n{R}"),
    (f"<html><body><article><h1>Mill<p>{P}<p>{Q}<ul><li>one thing<li>two things</ul><div class=advert>Boats!</div></article><footer>bye</footer>", f"Mill\n{P}\n{Q}\none thing\ntwo things"),
    (f"<body><nav role='navigation'>{MENU}</nav><div role='main'><h1>Bridge</h1><p>{R}</p><pre>a = 1</pre><p>{P}</p></div><div role='contentinfo'>Imprint</div></body>", f"Bridge\n{R}\na = 1\n{P}"),
    (f"<body><div class='popup' hidden><p>Subscribe today!</p></div><section class='article-body'><h1>Tide</h1><p>{P}</p><h3>Wind</h3><p>{Q}</p></section><div id='disqus'><p>First!</p></div></body>", f"Tide\n{P}\nWind\n{Q}"),
    (f"<article><h1>Tide</h1><p>{P}</p><noscript><p>Turn on scripts.</p></noscript><script>var p='<p>no</p>';</script><p>{R}</p></article>", f"Tide\n{P}\n{R}"),
    (f"<body><ul class='breadcrumbs'><li><a href=/>Home</a></li><li>News</li></ul><article><h1>Tide</h1><p class='lead'>{Q}</p><p>{P}</p></article><aside class='widget'><p>Weather: rain.</p></aside></body>", f"Tide\n{Q}\n{P}"),
    (f"<main><article><h1>Tide</h1><p>{P}</p><article class='comment'><p>Great piece.</p></article></article></main>", f"Tide\n{P}"),
    (f"<div><div class='entry-content'><p>{P}</p><p>{Q}</p></div><div class='tags'><a href=1>sea</a>, <a href=2>river</a></div></div>", f"{P}\n{Q}"),
]

#: Pages whose article no tag, class or role marks, and parts that only a heading, a link or a word tells.
PLAIN = [
    (P, P),
    ("Short", "Short"),
    (f"<body>{P}<br>{Q}</body>", f"{P} {Q}"),
    (f"<p>{P}<p>{Q}<p>Short one.", f"{P}\n{Q}\nShort one."),
    (f"<body><div>{P}</div><div>{Q}</div><div>{P}</div></body>", f"{P}\n{Q}\n{P}"),
    (f"<div><div>{P}</div><div>{Q}</div></div><div>Copyright 2020 Acme</div>", f"{P}\n{Q}"),
    (f"<div>{P}</div><div>{Q}</div><hr>&copy; 2020 Acme", f"{P}\n{Q}"),
    (f"<article><h1>Mill</h1><p>{P}</p></article><section><h2>Comments</h2><ol><li><p>{Q}</p></li><li><p>Nice.</p></li></ol></section>", f"Mill\n{P}"),
    (f"<article><h1>Mill</h1><p>{P}</p></article><section><h3>Responses</h3><article><p>{Q}</p></article></section>", f"Mill\n{P}"),
    (f"<article><h1>Mill</h1><p>{P}</p><p>All rights reserved.</p></article><footer>All rights reserved.</footer>", f"Mill\n{P}\nAll rights reserved."),
    (f"<article><h1>Trial</h1><h2>Methods</h2><p>{P}</p><h2>Discussion</h2><p>{Q}</p><p>{R}</p></article>", f"Trial\nMethods\n{P}\nDiscussion\n{Q}\n{R}"),
    (f"<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td><td><h1>Mill</h1><p>{P}</p><p>{Q}</p></td></tr></table>", f"Mill\n{P}\n{Q}"),
    (f"<table><tr><td>{MENU}</td><td>{P}</td></tr></table>", P),
    (f"<body><h1>Mill</h1><div>{P}</div><div>{Q}</div><h3>3 comments</h3><ul><li>{R}</li><li>Me too.</li></ul></body>", f"Mill\n{P}\n{Q}"),
    (f"<body><div><a href=/>Home</a> | <a href=/a>About</a></div><div><h2>Mill</h2><div>{P}</div><div>{Q}</div><div>{R}</div></div><div><h4>Related</h4>{MENU}</div></body>", f"Mill\n{P}\n{Q}\n{R}"),
    (f"<body><div class='x1'><div class='x2'>{P}</div><div class='x2'>{Q}</div></div><div class='x9'>&copy; 2019 The Paper. All rights reserved.</div></body>", f"{P}\n{Q}"),
]
