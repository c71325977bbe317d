"""A small labelled table of urls, written for this package; all names are invented. One url a line.

Both halves end with urls of the same forms (subdomains, languages, numbers, parameters, fragments), so that these forms
tell nothing and only the names do.
"""

#: Pages to read: news, reference works, documentation, schools, public bodies, blogs; then sites with plain names.
ALLOWED = """
https://www.morning-herald.com/en/politics/2021/05/12/council-votes-on-budget
https://news.city-gazette.org/fr/monde/article-48213.html
http://www.wochenblatt-nord.de/de/kultur/konzert-im-park-1182
https://diario-del-valle.es/es/noticias/cosecha-de-uvas
https://openwiki.org/wiki/Photosynthesis
https://de.openwiki.org/wiki/Segelboot
https://encyclopaedia.example-press.org/entry/solar-eclipse
https://docs.codebase.dev/en/stable/getting-started.html
https://docs.codebase.dev/en/stable/reference/iterators.html
https://learn.pandas-school.dev/tutorials/group-by
https://www.stonebridge.edu/departments/history/reading-list
https://library.northcollege.edu/catalogue/item/90233
https://physics.lakeuniversity.edu/lectures/waves-02
https://www.weather-office.gov/forecast/coast
https://health.county.gov/vaccines/questions
https://parliament.example.gov/debates/2019-11-04
https://museum-of-rivers.org/exhibits/old-bridges
https://garden-notes.net/2020/03/pruning-apple-trees
https://www.slowkitchen.com/recipes/lentil-soup
https://blog.mapmaker.org/en/8100
https://blog.treehouse-letters.com/posts/on-reading-aloud
https://travel-diary.net/en/46563?page=2
https://forum.beekeepers.org/threads/winter-feeding.2231
https://questions.code-help.com/12931/how-to-sort-a-list
https://journal-of-geology.org/articles/10-1203-basalt
https://arxiv-mirror.org/abs/1907.01234
https://www.chess-lessons.org/openings/italian-game
https://m.local-reporter.com/en/20596/
https://radio.harbour.fm/programmes/evening-science
https://www.birdwatch-society.org/species/kingfisher
https://history-archive.net/letters/1848/17
https://maths-corner.edu/geometry/circles
https://www.railway-museum.org.uk/collection/engines
https://translate-notes.org/fr/41470
https://www.poetry-room.org/poems/winter-morning
https://data.statistics.gov/population/tables
https://www.consumer-guide.org/tests/washing-machines
https://www.bookshelf-reviews.com/en/novels/the-long-river
https://astronomy-tonight.org/en/planets/saturn
https://hiking-trails.net/es/rutas/sierra
http://www.village-council.org/minutes/march
https://en.language-school.org/grammar/past-tense
https://www.theatre-review.net/en/31936.html
https://open-textbooks.edu/biology/chapter-4
https://www.legal-library.org/statutes/1974/copyright
https://blog.data-notes.dev/de/37213
https://www.film-journal.com/fr/critiques/4777
https://news.harbour-times.net/en/21470
https://manual.photo-editor.org/en/layers
https://www.farmers-weekly.org/en/soil/rotation
http://www.tionmer.example.com/en/31
https://m.therwald.example.net/de/207.html
http://blog.ththorn.example.org/fr/88?page=2&ref=x
https://www.thersole.example.com/es/540#top
http://thermill.example.net/en/61/
https://m.ontharn.example.org/de/19?utm_source=feed
http://www.retharin.example.com/en/733?page=2&ref=x
https://blog.tionard.example.net/fr/12.html
http://m.enthering.example.org/es/405/
https://thalerne.example.com/en/266#top
http://blog.ouandere.example.net/de/91
https://www.sternthe.example.org/fr/350?utm_source=feed
http://m.ndringer.example.com/en/128.html
https://bleration.example.net/es/77?page=2&ref=x
http://www.hathened.example.org/de/614/
https://m.lyonthre.example.com/fr/48#top
http://blog.whather.example.net/en/802
https://www.tiestion.example.org/es/93.html
http://ththarm.example.com/fr/271?page=2&ref=x
https://m.shoundth.example.net/de/36?utm_source=feed
http://www.river-walk.example.org/en/455
https://blog.old-town.example.com/de/18.html
http://m.garden-club.example.net/fr/620?page=2&ref=x
https://www.north-school.example.org/es/81#top
http://book-shelf.example.com/en/509/
https://m.day-report.example.net/de/244?utm_source=feed
http://www.bird-watch.example.org/fr/67
https://blog.stone-bridge.example.com/es/332.html
""".strip()

#: Pages to leave out: gambling, adult pages, pills, cracks, link farms, trackers, prizes; then sites with such names.
BLOCKED = """
http://best-casino-777.com/bonus?ref=aff123
http://free-slots-jackpot.net/register/free-spins
https://www.poker-bet-online.com/play?aff=99
https://spin-win-casino.club/en/bonus/no-deposit
http://casino-royal-bonus.xyz/slots/777
http://live-sportsbet-odds.top/bet?promo=win
http://xxx-cams-live.com/girls/1234
http://hot-adult-dating.net/sexy/profile?id=77
http://sexy-girls-chat.live/cams/free
http://adult-videos-xxx.biz/watch/9981
http://naked-cams-free.xyz/live/room
http://escort-dating-hot.info/girls
http://cheap-pills-online.biz/buy/viagra-online
http://buy-viagra-now.info/order?cheap=1
http://discount-pharmacy-pills.top/buy/cialis
http://cheap-meds-no-prescription.biz/buy
http://diet-pills-miracle.shop/order/now
http://warez-downloads.ru/cracked/keygen.exe
http://cracked-software-keygen.net/download/serial
http://torrent-movies-free.to/download/hd-rip
http://free-keygen-crack.biz/download?file=setup.exe
http://nulled-scripts-warez.xyz/download/12
http://serial-crack-download.top/keygen
http://ads.trackerclick.com/click?aff=55&sid=9
http://click-popunder.biz/redirect?url=1
http://ads.bannerfarm.top/click?campaign=77
http://track.popads-redirect.xyz/click?zone=3
http://pixel.adclick-tracker.biz/imp?aff=1
http://win-iphone-prize.xyz/claim-now?winner=1
http://free-giftcard-prize.top/claim/winner
http://you-are-winner.club/prize/iphone?claim=1
http://survey-reward-free.biz/claim?gift=1
http://fast-loan-approval.top/apply?ref=aff
http://payday-loan-cash-now.biz/apply
http://crypto-doubler.xyz/invest?ref=77
http://bitcoin-profit-fast.top/register?aff=8
http://forex-signals-profit.club/join?ref=5
http://replica-watches-sale.shop/buy/cheap/rolex
http://cheap-replica-bags.biz/buy?sale=1
http://seo-backlinks-cheap.biz/buy/links
http://buy-followers-cheap.top/order?likes=1000
http://link-farm-seo.xyz/backlinks/page77
http://essay-writing-cheap.info/order-now
http://cheap-essays-fast.biz/order?aff=3
http://make-money-fast-home.club/join?ref=12
http://get-rich-quick.top/register?ref=1
http://work-from-home-cash.xyz/join-now
http://miracle-weight-loss.biz/order?aff=2
http://free-download-cracked-games.top/keygen.exe
http://online-casino-bet-bonus.info/play?ref=7
http://www.cheap-meds.example.com/en/42
https://m.pills-online.example.net/de/218.html
http://blog.buy-pills.example.org/fr/79?page=2&ref=x
https://www.cheapest-pill.example.com/es/551#top
http://adult-cams.example.net/en/64/
https://m.x-adult.example.org/de/23?utm_source=feed
http://www.adult-xxx.example.com/en/741?page=2&ref=x
https://blog.hot-adult.example.net/fr/15.html
http://m.win-casino.example.org/es/412/
https://casino-bonus.example.com/en/259#top
http://blog.royal-casino.example.net/de/97
https://www.winners-casino.example.org/fr/343?utm_source=feed
http://m.bets-online.example.com/en/131.html
https://free-betting.example.net/es/72?page=2&ref=x
http://www.sure-bets.example.org/de/608/
https://m.free-slots.example.com/fr/53#top
http://blog.link-farm.example.net/en/811
https://www.spam-links.example.org/es/99.html
http://farm-links.example.com/fr/276?page=2&ref=x
https://m.spammy-farm.example.net/de/31?utm_source=feed
http://www.ads-click.example.org/en/467
https://blog.track-clicks.example.com/de/21.html
http://m.ad-tracker.example.net/fr/633?page=2&ref=x
https://www.track-ads.example.org/es/86#top
http://pop-ads.example.com/en/517/
https://m.prize-free.example.net/de/252?utm_source=feed
http://www.cracked-keys.example.org/fr/60
https://blog.free-crack.example.com/es/329.html
""".strip()
