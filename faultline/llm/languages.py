"""Sample sentences of European languages: letter pairs that are clean whatever the corpus holds."""

#: The opening article of the Universal Declaration of Human Rights and everyday sentences, in alphabets written with marked letters.
SENTENCES = """
All human beings are born free and equal in dignity and rights. It’s the naïve café’s “first” façade – a 20 °C résumé, £5, 7 €; § 4 • one… two — three © ® ™ ± ½ µ × ÷
Alle Menschen sind frei und gleich an Würde und Rechten geboren. Prüfung, größer, übermäßig, Änderung, Öffnung, Übergabe, schließen, Straße, Gerät, möglich, früh, Köln, gelöst, ausführen, täglich, für, „Lücke“, ungültige, Schlüssel
Tous les êtres humains naissent libres et égaux en dignité et en droits. L’échec a été corrigé très tôt ; où ça ? Même à l’été, la tâche réussit, cœur, nœuds, août, maïs, Noël, reçu, « début », contrôle, bientôt, hôte, goût, création, système, À prévoir, dérive, connaît
Todos los seres humanos nacen libres e iguales en dignidad y derechos. ¿Por qué falló mañana el pequeño análisis? ¡Así también! Según él, último, ejecución, versión, tamaño, código, línea, reintentó, «sí», más, vergüenza, público
Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Não há solução, configuração, três ações, você, também, está, saudáveis, será, às, avó, avô, último, início, conexão, botões, São, NÃO, ATENÇÃO, nós, versões, difícil
Все люди рождаются свободными и равными в своём достоинстве и правах. Объём, ещё, сборка упала, шаг не прошёл, журнал, щит, чья, эхо, юг, фильтр, цех, хвост, мьютекс, подъезд, №
Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. È già così, perché può, più, città, virtù, lunedì, però
Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Zażółć gęślą jaźń, błąd, więc, źródło, większość, ćwierć, żółw, sześć, można, wdrożenie, usługę, Łódź
Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Příliš žluťoučký kůň úpěl ďábelské ódy, řešení, ručně, šťastný, česky, můžeme, když, ještě, během, větší, přístup, každý
Všetci ľudia sa rodia slobodní a rovní v dôstojnosti aj právach. Kŕdeľ šťastných ďatľov učí pri ústí Váhu mĺkveho koňa, rýchly, môže, väčší
Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Árvíztűrő tükörfúrógép, idő, működik, először, több, című, erdő, gyűrű, hűség, következő, végül, őket, előtt, különböző
Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Bună dimineața, să fie, că, așa, încă, după, România, mâine, ţară, şi, două, către, găsi, între, lângă
Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Čitav đak žvače šećer, već, kuća, mogućnost, riječ, također
Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Pijamalı hasta yağız şoföre çabucak güvendi, değil, için, İstanbul, yanlış, çalışıyor, doğrulama, ağaç, küçük, sürüm, ışık
Alle mennesker er født frie og like i menneskeverd. Blåbærsyltetøy, få, når, også, å være, større, før, på, år, måned, Ærlig, Østlig
Alla människor är födda fria och lika i värde och rättigheter. Flygande bäckasiner söka hwila på mjuka tuvor, för, när, också, även, får, höra, åtgärd, större
Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Törkylempijävongahdus, yö, määrä, että, älä, myös, näkyy, löytää, käyttäjä
Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Põdur Zagrebi tšellomängija, üks, töö, või, müüs
Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Glāžšķūņa rūķīši, ātri, šī, kļūda, ģimene, pēc, tādēļ
Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Įlinkdama fechtuotojo špaga, ąžuolas, šįryt, dėl, į, tačiau, būti, žinių, reikšmės
Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Ξεσκεπάζω την ψυχοφθόρα βδελυγμία, ώρα, ήταν, πολύ, αρχείο, μήνυμα, σφάλμα
Всі люди народжуються вільними і рівними у своїй гідності та правах. Єхидна ґава, її, об’єкт, якщо, між, є, їжа, щось, помилка, виконання, після, зміни
Всички хора се раждат свободни и равни по достойнство и права. Ах чудна българска земьо, полюшвай цъфтящи жита, сървър, също, вход
"""
