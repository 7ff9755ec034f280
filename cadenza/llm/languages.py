"""Seed text for the language models: function words and plain sentences of our own, by language.

They start the training; sentences of the corpus that the first model is sure of are added to them.
"""

from __future__ import annotations

import re
import unicodedata

# Frequent function words, chosen from general knowledge of the languages.
LEXICON = {k: frozenset(v.split()) for k, v in {
    "en": "the a an and or but if then that this these those is are was were be been being have has had do does did not no nor of in on at by for with from to into over under about as so than too very can could will would shall should may might must i you he she it we they me him her us them my your his its our their what which who whom whose when where why how there here again once just only before after while until because since any some each every both more most other such own same now please let",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn dann dass ist sind war waren sein bin bist seid haben hat hatte habe hast nicht kein keine nichts nie von in im an am auf aus bei bis für mit nach seit zu zum zur über unter um als auch so sehr noch nur schon kann können könnte wird werden würde soll sollte muss darf ich du er sie es wir ihr mich mir dich dir ihn ihm uns euch mein dein unser was wer wie wo warum wann weil damit obwohl während bevor nachdem jetzt hier dort man doch mal bitte denn etwas jemand",
    "fr": "le la les un une des du de d et ou mais si que qui quoi dont est sont était être suis es êtes ai as a avons avez ont avait ne pas plus jamais rien aucun dans en sur sous par pour avec sans chez vers à au aux ce cet cette ces se sa son ses mon ma mes ton ta tes notre nos votre vos leur leurs je j tu il elle on nous vous ils elles me te lui y comment quand où pourquoi parce car comme très trop bien encore déjà toujours aussi alors donc puis après avant depuis pendant jusqu lorsque peut peux faut fait faire c qu n l s m t",
    "es": "el la los las un una unos unas y e o u pero si que qué quien cuál es son era ser soy eres está están estaba he has ha han había no ni nunca nada ningún en de del a al por para con sin sobre entre hasta desde hacia como cómo cuando cuándo donde dónde porque pues muy más menos mucho poco ya aún todavía también solo este esta estos estas ese esa eso aquel mi mis tu tus su sus nuestro me te se lo le les nos yo tú él ella usted ellos hay puede puedo tiene tengo debe hacer después antes mientras siempre otra otro",
    "pt": "o a os as um uma uns umas e ou mas se que quem qual é são era ser sou está estão estava tenho tem têm tinha há não nem nunca nada nenhum em de do da dos das no na nos nas ao à aos às por para pelo pela com sem sobre entre até desde como quando onde porque pois muito mais menos pouco já ainda também só este esta isto esse essa isso aquele meu minha seu sua nosso me te lhe eu tu ele ela você vocês nós eles pode posso deve fazer depois antes enquanto sempre outra outro foi fui senão então gente",
    "it": "il lo la i gli le un uno una e ed o ma se che chi cui quale è sono era essere sei siamo ho hai ha abbiamo avete hanno aveva non né mai niente nessuno in di del dello della dei degli delle a al allo alla ai alle da dal dalla nel nella sul sulla per con senza su tra fra fino come quando dove perché perche molto più meno poco già ancora anche solo questo questa questi quello quella mio mia tuo sua suo nostro mi ti si ci vi lo ne io tu lui lei noi voi loro può posso deve fare dopo prima mentre sempre così cosa altra altro",
    "nl": "de het een en of maar als dan dat die dit deze is zijn was waren ben bent heb hebt heeft had hebben niet geen niets nooit van in op aan bij door voor met naar uit tot over onder om te ook zo heel erg nog maar alleen al kan kunnen kon zal zou zullen moet moeten mag ik jij je u hij zij ze wij we jullie mij me hem haar ons mijn jouw uw onze wat wie waar waarom wanneer hoe omdat terwijl voordat nadat toen nu hier daar er iemand iets weer want dus toch even graag wordt worden",
    "ru": "и в во не на я он она оно мы вы они что чтобы это этот эта эти тот та те как так но а или если то же бы был была было были есть быть нет ни никогда ничего по с со к ко у о об от до из за для при без под над через между после перед пока когда где куда почему потому кто какой который мой твой свой наш ваш его её их меня мне тебя тебе нас вас им уже ещё еще только очень можно нужно надо может чем тоже опять снова сам лучше",
    "zh": "的 了 是 我 你 您 他 她 它 们 我们 你们 在 有 没 没有 不 也 都 就 还 很 会 能 要 可以 这 那 个 上 下 里 把 被 给 对 从 到 和 与 跟 请 吗 呢 吧 啊 什么 怎么 为什么 因为 所以 如果 但是 然后 之后 以后 时候 已经 一直 再 又 让 使",
    "ja": "の に は を が と も で へ や か から まで より です ます でした ました ません ない ください して した する なる ある いる こと もの ため とき これ それ あれ この その あの ここ そこ どこ なに なぜ どう もう まだ また まず 私 彼 よ ね たら なら ので のに だけ しか でも",
}.items()}

# Seed sentences, written for this module.
SEED = {k: [s.strip() for s in re.split(r"\n", v.strip())] for k, v in {
    "en": """
I have been trying to fix this since yesterday, and nothing seems to help.
Could you show me how the cover comes off without breaking the clips?
Thanks a lot, that was exactly what I needed to hear.
Put the pan on the stove and wait until the water starts to boil.
Keep your back straight while you lift the weight, then breathe out slowly.
The screen stays black whenever I plug the cable into the other port.
She said that the old version worked better than the new one.
You should never touch these wires while the power is still on.
Does anybody know which screws I have to remove first?
We bought it three years ago and it still runs without any trouble.
This is the best answer, so please mark it as accepted.
If the noise comes back, you will have to replace the whole wheel.
My guess is that somebody tightened it far too much.
Stop when the line is level and hold it there for ten seconds.
Same question from me, has there been any update?
Let it rest, turn it over and fold the edges toward the middle.""",
    "de": """
Ich versuche das seit gestern zu reparieren, aber nichts scheint zu helfen.
Kannst du mir zeigen, wie der Deckel abgeht, ohne dass die Haken brechen?
Vielen Dank, genau das wollte ich wissen.
Stell den Topf auf den Herd und warte, bis das Wasser kocht.
Halte den Rücken gerade, wenn du das Gewicht hebst, und atme langsam aus.
Der Bildschirm bleibt schwarz, sobald ich das Kabel in den anderen Anschluss stecke.
Sie hat gesagt, dass die alte Fassung besser lief als die neue.
Man darf diese Drähte niemals anfassen, solange der Strom noch an ist.
Welche Schrauben muss ich zuerst lösen, weiß das jemand?
Wir haben es vor drei Jahren gekauft, und es läuft noch immer ohne Probleme.
Das ist die beste Antwort, bitte als Lösung markieren.
Wenn das Geräusch wiederkommt, musst du das ganze Rad tauschen.
Vermutlich hat es jemand viel zu fest angezogen.
Hör auf, wenn die Linie waagerecht ist, und bleib zehn Sekunden so.
Gleiche Frage von mir, gibt es schon etwas Neues?
Lass ihn ruhen, drehe ihn um und klappe die Ränder zur Mitte.""",
    "fr": """
J'essaie de réparer cela depuis hier, mais rien ne semble aider.
Pouvez-vous me montrer comment enlever le couvercle sans casser les attaches ?
Merci beaucoup, c'est exactement ce que je voulais savoir.
Posez la casserole sur le feu et attendez que l'eau commence à bouillir.
Gardez le dos droit quand vous soulevez le poids, puis expirez lentement.
L'écran reste noir dès que je branche le câble dans l'autre prise.
Elle a dit que l'ancienne version marchait mieux que la nouvelle.
Il ne faut jamais toucher ces fils tant que le courant est allumé.
Quelqu'un sait-il quelles vis je dois enlever en premier ?
Nous l'avons acheté il y a trois ans et il tourne toujours sans problème.
C'est la meilleure réponse, merci de la valider.
Si le bruit revient, vous devrez changer toute la roue.
À mon avis, on l'a serré beaucoup trop fort.
Arrêtez quand la ligne est droite et restez ainsi dix secondes.
Même question pour moi, y a-t-il des nouvelles ?
Laissez-la reposer, retournez-la et repliez les bords vers le milieu.""",
    "es": """
Llevo desde ayer intentando arreglar esto y nada parece ayudar.
¿Puedes enseñarme cómo se quita la tapa sin romper los enganches?
Muchas gracias, era justo lo que quería saber.
Pon la cazuela al fuego y espera a que el agua empiece a hervir.
Mantén la espalda recta cuando levantes el peso y suelta el aire despacio.
La pantalla se queda negra en cuanto conecto el cable al otro puerto.
Ella dijo que la versión antigua funcionaba mejor que la nueva.
Nunca hay que tocar estos cables mientras la corriente siga encendida.
¿Sabe alguien qué tornillos tengo que quitar primero?
Lo compramos hace tres años y todavía funciona sin problemas.
Esta es la mejor respuesta, márcala como aceptada.
Si el ruido vuelve, tendrás que cambiar toda la rueda.
Creo que alguien lo apretó demasiado.
Para cuando la línea esté recta y quédate así diez segundos.
La misma pregunta por mi parte, ¿se sabe algo más?
Déjala reposar, dale la vuelta y dobla los bordes hacia el centro.
Súbelo con las dos manos y colócalo otra vez donde estaba.
Gracias, ya funciona todo bien, eso lo solucionó.
Primero mira la goma, porque suele estar rota.
Mi hermano dice que ahora solo necesita una gota de jabón.
Prefiero llamar a un técnico antes que abrirlo yo.
Por favor, manda algún vídeo para que veamos cómo lo haces.""",
    "pt": """
Estou tentando consertar isto desde ontem, mas nada parece ajudar.
Você pode me mostrar como a tampa sai sem quebrar as travas?
Muito obrigado, era exatamente o que eu queria saber.
Ponha a panela no fogão e espere até a água começar a ferver.
Mantenha as costas retas quando levantar o peso e solte o ar devagar.
A tela fica preta assim que ligo o cabo na outra porta.
Ela disse que a versão antiga funcionava melhor do que a nova.
Nunca se deve tocar nestes fios enquanto a energia estiver ligada.
Alguém sabe quais parafusos eu preciso tirar primeiro?
Compramos há três anos e ainda funciona sem nenhum problema.
Esta é a melhor resposta, por favor marque como aceita.
Se o barulho voltar, você vai ter que trocar a roda inteira.
Acho que alguém apertou demais.
Pare quando a linha estiver reta e fique assim dez segundos.
Mesma dúvida aqui, já tem alguma novidade?
Deixe descansar, vire e dobre as bordas para o meio.
Levante com as duas mãos e coloque outra vez onde estava.
Obrigado, agora já funciona tudo bem, isso resolveu.
Veja primeiro a borracha, porque ela costuma estar rasgada.
Meu irmão diz que agora só precisa de uma gota de sabão.
Prefiro chamar um técnico a abrir isso sozinho.
Por favor, mande um vídeo para a gente ver como você faz.""",
    "it": """
Sto cercando di aggiustarlo da ieri, ma non sembra che niente aiuti.
Puoi farmi vedere come si toglie il coperchio senza rompere i ganci?
Grazie mille, era proprio quello che volevo sapere.
Metti la pentola sul fuoco e aspetta che l'acqua cominci a bollire.
Tieni la schiena dritta quando sollevi il peso, poi butta fuori l'aria piano.
Lo schermo resta nero appena collego il cavo all'altra porta.
Lei ha detto che la vecchia versione andava meglio di quella nuova.
Non bisogna mai toccare questi fili finché la corrente è accesa.
Qualcuno sa quali viti devo togliere per prime?
L'abbiamo comprato tre anni fa e funziona ancora senza problemi.
Questa è la risposta migliore, segnatela come accettata.
Se il rumore torna, dovrai cambiare tutta la ruota.
Secondo me qualcuno l'ha stretto troppo.
Fermati quando la linea è dritta e resta così dieci secondi.
Stessa domanda anche per me, ci sono novità?
Lasciala riposare, girala e piega i bordi verso il centro.
Sollevalo con tutte e due le mani e rimettilo dov'era.
Grazie, adesso va tutto bene, così ho risolto.
Guarda prima la gomma, perché di solito è rotta.
Mio fratello dice che adesso ci vuole solo una goccia di sapone.
Preferisco chiamare un tecnico piuttosto che aprirlo da solo.
Per favore, manda un video così vediamo come fai.""",
    "nl": """
Ik probeer dit al sinds gisteren te maken, maar niets lijkt te helpen.
Kun je me laten zien hoe het deksel eraf gaat zonder de klemmen te breken?
Hartelijk dank, dat was precies wat ik wilde weten.
Zet de pan op het fornuis en wacht tot het water begint te koken.
Houd je rug recht als je het gewicht optilt en adem langzaam uit.
Het scherm blijft zwart zodra ik de kabel in de andere poort steek.
Ze zei dat de oude versie beter werkte dan de nieuwe.
Je moet deze draden nooit aanraken zolang de stroom er nog op staat.
Weet iemand welke schroeven ik eerst moet losdraaien?
We hebben het drie jaar geleden gekocht en het loopt nog steeds zonder problemen.
Dit is het beste antwoord, markeer het als oplossing.
Als het geluid terugkomt, zul je het hele wiel moeten vervangen.
Ik denk dat iemand het veel te strak heeft aangedraaid.
Stop als de lijn recht is en blijf zo tien seconden staan.
Dezelfde vraag van mij, is er al iets nieuws bekend?
Laat het rusten, draai het om en vouw de randen naar het midden.""",
    "ru": """
Я пытаюсь починить это со вчерашнего дня, но ничего не помогает.
Можете показать, как снять крышку, чтобы не сломать защёлки?
Большое спасибо, именно это я и хотел узнать.
Поставьте кастрюлю на плиту и подождите, пока вода закипит.
Держите спину прямо, когда поднимаете вес, и медленно выдыхайте.
Экран остаётся чёрным, как только я вставляю кабель в другой порт.
Она сказала, что старая версия работала лучше новой.
Никогда не трогайте эти провода, пока включено питание.
Кто знает, какие болты надо снять сначала?
Мы купили его три года назад, и он всё ещё работает без проблем.
Это лучший ответ, отметьте его как решение.
Если шум вернётся, придётся менять всё колесо.
Наверное, кто-то слишком сильно его затянул.
Остановитесь, когда линия станет ровной, и держите так десять секунд.
У меня тот же вопрос, есть ли новости?
Дайте тесту отдохнуть, переверните и загните края к середине.""",
    "zh": """
我从昨天开始就想把这个修好，可是怎么弄都没有用。
你能不能告诉我怎么把盖子拿下来，又不弄断卡扣？
非常感谢，这正是我想知道的。
把锅放到炉子上，等水烧开。
举重的时候背要挺直，然后慢慢呼气。
我一把线接到另一个接口，屏幕就黑了。
她说旧版本比新版本好用。
只要电源还开着，就绝对不能碰这些电线。
有谁知道应该先拆哪几个螺丝？
我们三年前买的，现在用起来还是没有问题。
这是最好的回答，请采纳。
如果声音又出现了，就得把整个轮子换掉。
我想是有人拧得太紧了。
线拉平的时候停下来，保持十秒钟。
我也有同样的问题，后来怎么样了？
先放一会儿，翻过来，再把边往中间折。""",
    "ja": """
昨日から直そうとしていますが、何をしても駄目です。
爪を折らずにふたを外す方法を教えてもらえますか。
ありがとうございます、それが知りたかったのです。
鍋を火にかけて、お湯が沸くまで待ってください。
重りを持ち上げるときは背中を伸ばし、ゆっくり息を吐きます。
ケーブルを別の端子に差すと、すぐに画面が黒くなります。
彼女は古い版のほうが新しい版よりよく動くと言いました。
電源が入っている間は、この線に決して触らないでください。
どのねじを最初に外せばいいか、誰か分かりますか。
三年前に買いましたが、今でも問題なく動いています。
これが一番いい回答なので、解決にしてください。
また音がしたら、車輪を全部取り替えるしかありません。
誰かがきつく締めすぎたのだと思います。
線がまっすぐになったら止めて、十秒そのままにします。
同じ質問があります、その後どうなりましたか。
しばらく休ませてから裏返し、端を真ん中に折ります。""",
}.items()}

# Code, commands, logs and settings without a language, written for this module: blocks of lines.
CODE = [[x for x in block.split("\n") if x.strip()] for block in r"""
def total_of(items, rate=0.2):
    # sum up all items before the tax is added
    result = sum(x.price for x in items)
    if result > limit:
        raise ValueError("too much")
    for item in items:
        item.done = True
    while not queue.empty():
    return result * (1 + rate)
with open(path, encoding="utf-8") as handle:
class Parser(Base):
import numpy as np
from os import path
print(total_of(basket))
    else:
        pass
====
function render(list) {
  // draw every row again when the list changes
  const rows = list.filter(r => r.visible);
  let node = document.getElementById('root');
  if (!node) {
    return null;
  }
  node.innerHTML = rows.map(r => r.name).join(', ');
  await fetch(url).then(res => res.json());
}
export default render;
var counter = 0;
counter += step;
====
#include <stdio.h>
int main(int argc, char **argv) {
    /* print the value and leave */
    printf("%d\n", value);
    for (int i = 0; i < n; i++) {
        sum += values[i];
    }
    return 0;
}
struct node *next;
static const double ratio = 1.5;
====
SELECT name, count(*) FROM users GROUP BY name;
select id, total from orders where total > 100 order by id;
-- delete the old rows first
DELETE FROM sessions WHERE expired = 1;
insert into log (id, message) values (7, 'done');
update accounts set balance = 0 where id = 12;
CREATE TABLE points (x int, y int);
alter table points add column z int
join customers c on c.id = o.customer_id
====
$ cd /var/www && ls -la
$ ./configure --prefix /usr/local
sudo apt install python3-dev
sudo systemctl restart nginx
git commit -m "first version"
docker run --rm -it -p 80:80 web
cat access.log | grep error | sort | uniq -c > counts.txt
curl -X POST -d @body.json
pip install requests
chmod +x run.sh
rm -rf build/
npm run build -- --watch
$ make -j4 install
$ ./start.sh --verbose
$ ./setup --user root --force
$ tar -xzf archive.tar.gz
$ python main.py --input data.csv
ls -la /etc
echo $USER
mkdir -p out && mv file.txt out/
ssh user@host -p 22
find . -name "*.txt" -print
kill -9 1234
if (x > y) {
>>> len(values)
# start the service again
export PATH=$PATH:/opt/bin
====
2021-03-04 11:22:33 INFO server started on port 8080
2021-03-04 11:22:34 WARN cache miss for key user
[ERROR] connection refused by host
ERROR: could not open file
WARN [pool] worker timed out after 30 ms
INFO [main] ready in 12 ms
DEBUG main.c:42 buffer flushed
Mar 04 11:22:33 host kernel: usb disconnected
level=info msg="request done" status=200
Traceback (most recent call last):
  File "main.py", line 3, in <module>
NullPointerException at Main.java:17
    at com.example.Main.run(Main.java:17)
Segmentation fault (core dumped)
process exited with code 1
====
server:
  port: 8080
  host: localhost
[section]
key = value
timeout=30
"name": "example",
"version": "1.0.0",
{
}
<config>
  max_size: 20
enabled: true
====
# Daten laden und prüfen
daten = lade("werte.csv")
# nur die letzten zehn Werte behalten
werte = daten[-10:]
// charger les données puis trier
liste.sort();
// primero se abre el archivo
archivo.open("r");
// データを読み込む
load(data);
// 读取文件
file.read();
# открыть файл и прочитать
f = open(name)
====
public static void main(String[] args) {
    List<String> names = new ArrayList<>();
    names.add("a");
    System.out.println(names.size());
    try {
        run();
    } catch (IOException e) {
        e.printStackTrace();
    }
}
fn area(w: f64, h: f64) -> f64 {
    let a = w * h;
    println!("{}", a);
func Add(a int, b int) int {
    return a + b
puts "hello" if ready
end
""".strip().split("\n====\n")]

LANGUAGES = tuple(SEED)

# Names under which a language appears in labels (ISO 639-1 codes are added).
NAMES = {
    "en": "eng english englisch anglais inglés inglês inglese engels английский 英语 英文 英語",
    "de": "deu ger german deutsch allemand alemán alemão tedesco duits немецкий 德语 德文 ドイツ語",
    "fr": "fra fre french français francais französisch francés francês francese frans французский 法语 法文 フランス語",
    "es": "spa spanish español espanol castellano spanisch espagnol espanhol spagnolo spaans испанский 西班牙语 西班牙文 スペイン語",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portoghese portugees португальский 葡萄牙语 ポルトガル語",
    "it": "ita italian italiano italienisch italien italiaans итальянский 意大利语 イタリア語",
    "nl": "nld dut dutch nederlands niederländisch néerlandais neerlandés holandês olandese нидерландский 荷兰语 オランダ語",
    "ru": "rus russian русский russisch russe ruso russo 俄语 俄文 ロシア語",
    "zh": "zho chi cmn chinese 中文 汉语 漢語 chinesisch chinois chino chinês cinese chinees mandarin китайский 中国語",
    "ja": "jpn japanese 日本語 日语 japanisch japonais japonés japonês giapponese japans японский",
}
BY_NAME = {n: k for k, v in NAMES.items() for n in (k, *v.split())}
# Codes of further languages that a label may name; none of them has a model.
_OTHER = re.compile(r"^[a-z]{2,3}$")


def label(lang: str | None) -> str | None:
    """The two-letter code that a label names in any usual way (case, region, three letters, name), else None."""
    if not lang:
        return None
    x = unicodedata.normalize("NFKC", lang).strip().casefold()
    return BY_NAME.get(x) or BY_NAME.get(re.split(r"[-_. (]", x)[0])


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
