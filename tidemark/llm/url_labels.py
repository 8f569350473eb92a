"""The labelled urls that the url filter is trained from, one a line.

Labelled by hand: unwanted are advertising and tracking, adult content, gambling, illegal
copies, cheap medicine, loans and other bait, link farms and login bait. The rest are
encyclopedias, news, documentation, schools, public bodies, shops, code and personal pages.
Hosts are public ones or plain inventions in their style.
"""

UNWANTED = """
https://ad.doubleclick.net/ddm/trackclk/N1234.site/B8765
https://pagead2.googlesyndication.com/pagead/js/adsbygoogle.js
https://www.googleadservices.com/pagead/aclk
https://cdn.taboola.com/libtrc/loader.js
https://widgets.outbrain.com/outbrain.js
https://secure.adnxs.com/seg
https://ads.pubmatic.com/AdServer/js/pwt.js
https://static.criteo.net/js/ld/publishertag.js
https://bidder.criteo.com/cdb
https://tracking.bannerhost.io/impression/9931
https://adserver.mediapartner.biz/delivery/ck.php
https://ads.localherald.info/banner/468x60.html
https://popads.trafficbuy.biz/popunder/start
https://click.mailblast.co/track/open
https://trk.affiliatehub.xyz/aff_c
https://go.affrewards.click/offer/claim-now
https://pixel.adtargeting.net/sync/pixel
https://adclick.bestrevenue.top/redirect/out
https://www.pushnotify-ads.online/subscribe/allow
https://ads2.videoroll.tv/preroll/vast.xml
https://beacon.usertrackers.com/collect/pageview
https://sponsored.linkfeed.biz/widget/ads.html
https://cpm.adnetworkpro.com/serve/banner
https://rtb.adexchange-one.com/bid/request
https://counter.hitstats-free.net/hit/track.php
https://www.hotsexvideos.xxx/watch/amateur-threesome
https://free-porn-tube.xxx/category/milf
https://livecams-adult.com/girls/online
https://nudegirls.cam/gallery/naked-teen-18
https://www.xxxmovies4free.net/hd/hardcore
https://sexcams.chatlive.cam/rooms/fetish
https://adultfriend-dating.net/hookup/tonight
https://eroticstories-xxx.com/stories/taboo
https://bigtits.pornhaus.tv/video/busty-blonde
https://escort-babes-24.com/city/vip-escorts
https://hentaisexclub.net/manga/uncensored
https://fetishporn.club/videos/bdsm
https://www.slutwives.xxx/index.html
https://hookups-near-you.date/join/free
https://onlycams.sexlive.xyz/model/private-show
https://www.bigwincasino.com/slots/free-spins
https://casino-bonus-codes.net/no-deposit-bonus
https://online-poker-stars247.com/texas-holdem/download
https://bet-now.sportsbook.bet/odds/football
https://luckyslots777.club/jackpot
https://royal-roulette.casino/live/blackjack
https://slotmachine-vegas.xyz/free-slots
https://betting-tips-sure.win/today/sure-bets
https://www.jackpotcity-casino.online/welcome-bonus
https://bingo-lotto-win.com/scratchcards
https://poker-chips-bonus.top/register/bonus
https://gambling-sites-uk.biz/casino/review-best-casinos
https://crypto-casino.bet/dice/provably-fair
https://cheap-viagra-online.biz/order/cialis-without-prescription
https://canadian-pharmacy-meds.com/buy/viagra-generic
https://rx-pills-discount.net/tramadol/no-prescription
https://buy-cialis24.xyz/cheap-cialis
https://weightloss-keto-pills.shop/order/keto-gummies
https://male-enhancement-pills.club/buy-now
https://onlinepharma-noprescription.top/xanax
https://steroids-for-sale.biz/buy/anabolic
https://miracle-diet-pill.info/lose-weight-fast
https://payday-loans-fast.com/apply/bad-credit
https://instant-cash-loan.biz/no-credit-check
https://debt-relief-now.info/apply-now
https://get-rich-quick-crypto.io/double-your-bitcoin
https://bitcoin-doubler.win/invest/free-btc
https://forex-signals-profit.club/make-money-fast
https://earn-money-online.click/work-from-home
https://free-giftcards-generator.xyz/claim/itunes
https://win-free-iphone.club/survey/prize
https://congratulations-winner.top/claim-prize
https://your-reward-waiting.click/spin-wheel
https://free-robux-generator.online/hack
https://hot-deals-cheap.shop/replica/rolex
https://replica-watches-outlet.biz/cheap/louis-vuitton
https://cheap-nfl-jerseys.us.com/wholesale
https://discount-handbags-outlet.top/sale/90-off
https://www.warez-downloads.to/full/crack-keygen
https://serial-keygen-crack.net/download/photoshop-crack
https://torrent-movies-free.to/download/1080p-bluray
https://watch-movies-free-hd.stream/full-movie/123movies
https://piratedsoftware.xyz/windows-activator-crack
https://free-mp3-download.cc/album/zip
https://cracked-apk-mod.club/unlimited-coins
https://hack-accounts.online/instagram/password
https://paypal-login.verify-account.xyz/signin/confirm
https://secure-bank-update.info/login/verify.php
https://appleid.apple.com.account-locked.top/unlock
https://microsoft-support-alert.online/virus-warning
https://netflix-billing.update-payment.click/login
https://amazon-order-confirm.top/signin/update-card
https://your-pc-infected.site/scan/call-now
https://free-antivirus-scan.download/setup.exe
https://driver-updater-free.download/install.exe
https://best-seo-backlinks.biz/buy/1000-backlinks
https://seo-link-directory.info/submit/free-links
https://spun-articles.xyz/tag/cheap-insurance-quotes
https://insurance-quotes-cheap.biz/auto/free-quote
https://essay-writing-cheap.top/buy-essay
https://buy-followers-cheap.club/instagram-likes
https://parked-domain-ads.com/search/sponsored-listings
https://traffic-bot.click/buy-visitors
"""

WANTED = """
https://en.wikipedia.org/wiki/Photosynthesis
https://de.wikipedia.org/wiki/Bodensee
https://fr.wiktionary.org/wiki/maison
https://www.britannica.com/science/plate-tectonics
https://plato.stanford.edu/entries/kant-moral
https://arxiv.org/abs/1706.03762
https://www.nature.com/articles/s41586-020-2649-2
https://pubmed.ncbi.nlm.nih.gov/31978945
https://www.gutenberg.org/files/1342/1342-h/1342-h.htm
https://docs.python.org/3/library/itertools.html
https://spark.apache.org/docs/latest/sql-programming-guide.html
https://developer.mozilla.org/en-US/docs/Web/HTML/Element
https://kubernetes.io/docs/concepts/workloads/pods
https://www.postgresql.org/docs/current/indexes.html
https://doc.rust-lang.org/book/ch04-01.html
https://github.com/numpy/numpy/blob/main/README.md
https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster
https://news.ycombinator.com/item
https://www.bbc.co.uk/news/science-environment
https://www.theguardian.com/world/2019/mar/02/article
https://www.nytimes.com/2018/05/11/travel/what-to-do-in-lisbon.html
https://www.lemonde.fr/planete/article/2020/01/12/le-climat.html
https://www.spiegel.de/wissenschaft/mensch/forschung-a-1234567.html
https://elpais.com/cultura/2021-03-04/la-novela.html
https://www.reuters.com/markets/commodities
https://www.npr.org/sections/health-shots
https://www.nasa.gov/mission_pages/station/main/index.html
https://www.nps.gov/yell/planyourvisit/hikes.htm
https://www.loc.gov/collections/maps
https://www.cdc.gov/flu/prevent/index.html
https://europa.eu/european-union/topics/agriculture
https://www.who.int/news-room/fact-sheets/detail/malaria
https://data.gov.uk/dataset/river-levels
https://www.parliament.uk/business/committees
https://stadt-koeln.de/leben-in-koeln/bildung
https://www.mit.edu/research/energy
https://cs.uni-freiburg.edu/lectures/algorithms/notes.pdf
https://ocw.school.edu/courses/linear-algebra/lecture-3
https://library.riverside.edu/guides/citation
https://museum.oslo.no/exhibitions/viking-ships
https://www.natural-history-museum.org/collections/minerals
https://www.imdb.com/title/tt0111161
https://www.allrecipes.com/recipe/20144/banana-bread
https://grandmas-kitchen.org/recipes/apple-pie
https://www.seriouseats.com/how-to-cook-rice
https://gardeners-corner.net/forum/roses/pruning-in-spring
https://www.lonelyplanet.com/italy/florence
https://hikingtrails.info/alps/day-hikes
https://sailing-diary.blogspot.com/2014/06/across-the-bay.html
https://marys-garden.wordpress.com/2016/09/10/autumn-leaves
https://medium.com/@writer/notes-on-reading-slowly-8f2c
https://blog.janedoe.me/posts/learning-to-paint
https://www.woodworking-weekly.com/projects/oak-table
https://chessclub.cz/history/tournaments-1987
https://www.birdwatchers.org.uk/species/robin
https://model-railways.net/layouts/n-gauge
https://www.weather.gov/forecast/zone
https://meteo.ch/prevision/geneve
https://www.openstreetmap.org/way/23456
https://archive.org/details/oldnewspapers1898
https://www.bookreviews.net/fiction/a-quiet-winter
https://poetry-foundation.org/poems/the-river
https://letters.historian.org.uk/1812/march
https://genealogy.familytrees.net/surname/miller
https://local-theatre.org/season/programme
https://parish-church.org.uk/notices/sunday
https://cityorchestra.com/concerts/spring
https://www.farmersmarket.coop/opening-hours
https://bakery-lindner.de/brot/roggen
https://www.bikeshop-utrecht.nl/reparatie
https://www.ikea.com/gb/en/cat/bookcases
https://www.etsy.com/listing/hand-made-mug
https://shop.teahouse.jp/green-tea/sencha
https://www.hardwarestore.co/hand-tools/chisels
https://carparts-direct.co.uk/brakes/pads
https://www.volkshochschule.at/kurse/sprachen
https://primary-school-elm.sch.uk/news/sports-day
https://kids-science.org/experiments/volcano
https://mathforum.org/problems/geometry/triangle
https://www.khanacademy.org/math/algebra
https://wiki.archlinux.org/title/Installation_guide
https://linux.die.net/man/1/grep
https://tldp.org/HOWTO/Bash-Prog-Intro-HOWTO.html
https://forum.arduino.cc/t/servo-jitter/1201
https://community.home-automation.io/t/lights/554
https://lists.gnu.org/archive/html/emacs-devel/2012-02/msg00011.html
https://bugs.debian.org/cgi-bin/bugreport.cgi
https://pypi.org/project/pandas
https://crates.io/crates/serde
https://hub.docker.com/_/redis
https://cran.r-project.org/web/packages/ggplot2/index.html
https://www.w3.org/TR/css-grid-1
https://datatracker.ietf.org/doc/html/rfc2616
https://unicode.org/reports/tr29
https://law.cornell.edu/uscode/text/17/107
https://legifrance.gouv.fr/codes/article
https://gesetze-im-internet.de/bgb/index.html
https://www.transport.gov.au/roads/projects
https://railway-timetable.eu/vienna-prague
https://airport-info.net/terminal/maps
https://hotel-seeblick.ch/zimmer
https://bed-and-breakfast-cornwall.co.uk/rooms
https://www.yogastudio.se/schema
https://physio-practice.ie/back-pain
https://dentist-maple-street.com/appointments
https://hospital.org/departments/cardiology
https://patient.info/doctor/asthma
https://vet-clinic.nz/cats/vaccination
https://www.fishing-reports.com/rivers/trout
https://football-club-albion.com/fixtures
https://running-club.org/results/half-marathon
https://www.nba.com/games/schedule
https://chess.com/article/view/openings
https://guitar-lessons.net/chords/beginner
https://lyricsarchive.net/folk/ballads
https://photography-basics.com/exposure/aperture
https://knitting-patterns.org/free/scarf
https://quilters-guild.org/gallery
https://astro-amateur.net/telescope/eyepieces
https://geology-field-notes.org/basalt
https://economics-review.org/inflation-1970s
https://podcast-history.fm/episodes/byzantium
https://radio.bayern.de/sendungen/klassik
https://tv-guide.net/tonight
https://film-archive.cz/silent-films
https://comics-museum.be/exposition
https://startup-journal.com/founders/interview
https://company.com/about-us/careers
https://engineering-blog.dev/2020/caching
https://adriatic-cruises.hr/islands
https://addison-county.org/planning
https://admissions.college.edu/apply
https://trackandfield.org/records
https://betty-smith.com/watercolours
https://sussex-walks.org.uk/downs
https://essex-library.gov.uk/branches
https://click-chemistry-lab.edu/publications
"""


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for unwanted or 0) of the two lists."""
    return [(u, y) for y, block in ((1, UNWANTED), (0, WANTED)) for u in block.split()]
