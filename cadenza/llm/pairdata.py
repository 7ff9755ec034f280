"""Phrases from which defective and sound replies are made for training, by language (en, de, fr, es, zh).

`{x}` stands for a sound reply, `{q}` for a question, `{n}` for a language. They are training text: nothing here is
matched against the data.

Where they come from: the lists were written anew from general knowledge of how assistants speak, in place of an earlier set
that was partly worded after the synthetic tables and that was known to the writer. REFUSAL_PARTS, SHORT_PARTS, the later
entries of SHORT ("Turn it off" and what follows it, in each language) and the last entries of NEAR_REFUSAL were added after
looking at replies of sf0.01 and check_s that the first version got wrong. They are grammars of general words, but they
were aimed at those replies and can make some of them word for word.
"""

from __future__ import annotations

# What stands for no content, beside white space and signs.
NULLS = ("null none nil nan na n/a n.a. empty undefined blank void missing tbd todo unknown nothing unset absent unavailable "
         "leer keine vide aucun vacío ninguno 无 空 未知").split()
CONTROL = ["<pad>", "<eos>", "<s>", "</s>", "<unk>", "<bos>", "<mask>", "<|endoftext|>", "<|im_end|>", "<|eot_id|>", "<|end|>", "<|pad|>", "[PAD]", "[UNK]", "[EOS]", "[BOS]", "[SEP]",
           "[CLS]", "[MASK]", "[END]", "[EMPTY]", "<empty>", "<null>", "<end_of_turn>"]
BLANKS = ["", " ", "\n", " \t ", "\xa0", "​", "﻿", "⁠", "...", "…", ".", "。", "-", "--", "—", "?", "!", "\"\"", "''", "``", "()", "[]", "{}", "*", "**", "_", "|", "~", "#", "```", "•", ",", ":", "「」"]

INTRO = {
    "en": ["You asked: {q}", "Question: {q}", "Your question: {q}", "Your question was: {q}", "The question is: {q}", "You want to know: {q}", "You wrote: {q}", "User: {q}", "So, {q}", "Regarding your question: {q}", "Repeating: {q}", "Let me repeat: {q}"],
    "de": ["Du fragst: {q}", "Frage: {q}", "Ihre Frage: {q}", "Deine Frage war: {q}", "Die Frage lautet: {q}", "Du willst wissen: {q}", "Sie haben gefragt: {q}", "Nutzer: {q}", "Also, {q}", "Zur Frage: {q}"],
    "fr": ["Vous demandez : {q}", "Question : {q}", "Votre question : {q}", "La question est : {q}", "Vous avez demandé : {q}", "Tu veux savoir : {q}", "Utilisateur : {q}", "Donc, {q}", "Concernant la question : {q}"],
    "es": ["Preguntas: {q}", "Pregunta: {q}", "Tu pregunta: {q}", "La pregunta es: {q}", "Has preguntado: {q}", "Quieres saber: {q}", "Usuario: {q}", "Entonces, {q}", "Sobre la pregunta: {q}"],
    "zh": ["你问：{q}", "问题：{q}", "您的问题：{q}", "你的问题是：{q}", "您想知道：{q}", "用户：{q}", "关于这个问题：{q}", "您问的是：{q}"],
}

# Refusals: openings, ways to decline, what is declined, and reasons or closings; and whole sentences.
REFUSAL = {
    "en": (["", "", "I'm sorry, but ", "Sorry, ", "Sorry, but ", "I am sorry, ", "I apologize, but ", "Unfortunately, ", "Unfortunately ", "I'm afraid ", "My apologies, ", "Apologies, but ", "Regrettably, ", "Thank you for asking, but ", "As an AI, ",
            "As a language model, ", "As an assistant, ", "I understand the request, but ", "Hmm, "],
           ["I can't ", "I cannot ", "I can not ", "I'm unable to ", "I am not able to ", "I won't be able to ", "I will not ", "I won't ", "I must decline to ", "I have to decline to ", "I'd rather not ", "I am not allowed to ", "I'm not permitted to ",
            "it is not possible for me to ", "I have no way to ", "I refuse to ", "we cannot ", "we are unable to ", "I don't feel comfortable to ", "my guidelines do not allow me to ", "my policy forbids me to ", "I'm not in a position to ", "I may not ", "I could not "],
           ["help with that", "help you with this", "assist with this request", "assist you here", "answer that", "answer your question", "answer this", "comment on this", "discuss such topics", "provide that", "provide instructions for this", "do that",
            "respond to this", "give advice on this matter", "evaluate this video", "explain this", "identify anybody here", "describe this scene", "judge this", "take part in this", "fulfil this request", "complete this task", "process the request",
            "share details about it", "tell you that", "guide you through this", "support this", "say anything about it", "recommend anything", "make a statement on that", "continue with this", "help"],
           ["", "", ".", ".", " right now.", " at this time.", " for safety reasons.", " because it could be dangerous.", " because it may be harmful.", " since I lack the information.", " as I have no access to the video.", ". Please consult a professional.",
            ". Please ask an expert.", ", as it violates my policy.", ". Is there something else I can do for you?", " under my guidelines.", ". Try asking something else.", " without more context.", " since I cannot see the images.", ". I hope you understand.",
            ", please contact a qualified person.", " because of the rules I follow."],
           ["I have no answer for you.", "That is beyond my abilities.", "This goes against my guidelines.", "I am not the right one to ask.", "Request denied.", "Request refused.", "I decline.", "No comment.", "This request cannot be processed.",
            "I do not have enough information to answer.", "This is not something I can do.", "I am only an AI and have no opinion on that.", "That information is not available to me.", "I must refuse.", "I prefer not to say.", "The content policy does not allow an answer.",
            "This falls outside my scope.", "You will have to ask somebody else.", "I don't give advice of this kind.", "Such questions are not answered here.", "I'm not going to answer that.", "That's not something I'm able to talk about.", "My rules do not permit an answer to this."]),
    "de": (["", "", "Es tut mir leid, aber ", "Tut mir leid, ", "Entschuldigung, aber ", "Entschuldigung, ", "Leider ", "Bedauerlicherweise ", "Danke für die Frage, aber ", "Als KI ", "Als Sprachmodell ", "Als Assistent ", "Ich verstehe die Bitte, aber "],
           ["kann ich ", "ich kann ", "darf ich ", "ich darf ", "werde ich ", "ich werde ", "ist es mir nicht möglich, ", "es ist mir nicht möglich, ", "wir können ", "ich möchte lieber ", "ich bin nicht befugt, ", "ich sehe mich nicht in der Lage, ", "ich weigere mich, "],
           ["dabei nicht helfen", "dir dabei nicht helfen", "Ihnen nicht helfen", "diese Frage nicht beantworten", "darauf nicht antworten", "dazu nichts sagen", "keine Auskunft dazu geben", "diese Anfrage nicht bearbeiten", "das nicht beurteilen", "das nicht tun",
            "keine Anleitung dafür geben", "über dieses Thema nicht sprechen", "das Video nicht bewerten", "keinen Rat dazu geben", "niemanden erkennen", "das nicht erklären", "hier nicht weiterhelfen", "diese Aufgabe nicht übernehmen", "dazu Stellung zu nehmen", "darauf zu antworten"],
           ["", "", ".", ".", ", weil es gefährlich sein könnte.", " aus Sicherheitsgründen.", ", da mir die Informationen fehlen.", ", denn ich habe keinen Zugriff auf das Video.", ". Bitte fragen Sie einen Fachmann.", ". Bitte wende dich an eine Fachkraft.", ", das widerspricht meinen Richtlinien.",
            ". Kann ich sonst noch etwas tun?", " ohne weitere Angaben.", ". Ich bitte um Verständnis."],
           ["Dazu habe ich keine Antwort.", "Das übersteigt meine Fähigkeiten.", "Das verstößt gegen meine Richtlinien.", "Ich bin dafür nicht der Richtige.", "Anfrage abgelehnt.", "Ich lehne ab.", "Kein Kommentar.", "Diese Anfrage kann nicht bearbeitet werden.",
            "Mir fehlen die Angaben für eine Antwort.", "Das ist mir nicht möglich.", "Das muss ich ablehnen.", "Dazu möchte ich nichts sagen.", "Das liegt nicht in meinem Bereich.", "Solche Fragen beantworte ich nicht.", "Bitte fragen Sie jemand anderen.", "Die Regeln erlauben mir hier keine Antwort."]),
    "fr": (["", "", "Je suis désolé, mais ", "Désolé, ", "Désolée, mais ", "Pardon, mais ", "Malheureusement, ", "Excusez-moi, mais ", "Je regrette, ", "Merci de votre question, mais ", "En tant qu'IA, ", "En tant que modèle de langage, ", "En tant qu'assistant, "],
           ["je ne peux pas ", "je ne puis ", "je ne suis pas en mesure de ", "je ne suis pas capable de ", "je ne suis pas autorisé à ", "il m'est impossible de ", "je refuse de ", "je dois refuser de ", "je préfère ne pas ", "nous ne pouvons pas ", "mes règles m'interdisent de ", "je n'ai pas le droit de ", "je ne vais pas "],
           ["vous aider", "t'aider avec cela", "répondre à cette question", "répondre à cela", "vous répondre", "traiter cette demande", "donner de conseils à ce sujet", "commenter cela", "parler de ce sujet", "juger cette vidéo", "expliquer cela", "faire cela", "donner ces instructions",
            "identifier cette personne", "décrire la scène", "donner mon avis", "accomplir cette tâche", "fournir cette information", "dire quoi que ce soit"],
           ["", "", ".", ".", " pour des raisons de sécurité.", " car cela pourrait être dangereux.", " faute d'informations.", " car je n'ai pas accès à la vidéo.", ". Veuillez consulter un professionnel.", ". Adressez-vous à un expert.", ", cela va à l'encontre de mes règles.",
            ". Puis-je faire autre chose ?", " sans plus de contexte.", ". Merci de votre compréhension."],
           ["Je n'ai pas de réponse.", "Cela dépasse mes capacités.", "C'est contraire à mes règles.", "Demande refusée.", "Je refuse.", "Pas de commentaire.", "Cette demande ne peut pas être traitée.", "Je n'ai pas assez d'informations pour répondre.", "Ce n'est pas dans mes possibilités.",
            "Je dois décliner.", "Je préfère ne rien dire.", "Cela sort de mon domaine.", "Je ne réponds pas à ce genre de questions.", "Demandez plutôt à quelqu'un d'autre.", "Mes règles ne me permettent pas d'y répondre."]),
    "es": (["", "", "Lo siento, pero ", "Lo siento, ", "Perdón, pero ", "Disculpa, ", "Lamentablemente, ", "Por desgracia, ", "Me temo que ", "Gracias por la pregunta, pero ", "Como IA, ", "Como modelo de lenguaje, ", "Como asistente, "],
           ["no puedo ", "no soy capaz de ", "no estoy autorizado a ", "no me está permitido ", "me es imposible ", "no me es posible ", "me niego a ", "debo negarme a ", "prefiero no ", "no podemos ", "no voy a ", "mis normas no me dejan ", "no tengo permiso para "],
           ["ayudarte con eso", "ayudarle", "responder a esa pregunta", "responder a eso", "contestar", "atender esta solicitud", "dar consejos sobre ese tema", "comentar eso", "hablar de ese tema", "juzgar este vídeo", "explicar eso", "hacer eso", "dar esas instrucciones",
            "identificar a nadie", "describir la escena", "dar mi opinión", "realizar esa tarea", "proporcionar esa información", "decir nada al respecto"],
           ["", "", ".", ".", " por motivos de seguridad.", " porque podría ser peligroso.", " por falta de información.", " porque no tengo acceso al vídeo.", ". Consulta a un profesional.", ". Pregunta a un experto.", ", va en contra de mis normas.", ". ¿Puedo hacer otra cosa por ti?",
            " sin más contexto.", ". Espero que lo entiendas."],
           ["No tengo respuesta para eso.", "Eso supera mis capacidades.", "Eso va contra mis normas.", "Solicitud denegada.", "Me niego.", "Sin comentarios.", "Esta solicitud no se puede procesar.", "No tengo suficiente información para responder.", "No está en mi mano.", "Debo rechazarlo.",
            "Prefiero no decirlo.", "Eso queda fuera de mi ámbito.", "No respondo a ese tipo de preguntas.", "Es mejor que preguntes a otra persona.", "Mis reglas no me permiten responder."]),
    "zh": (["", "", "很抱歉，", "抱歉，", "对不起，", "不好意思，", "非常遗憾，", "感谢您的提问，但是", "作为一个人工智能，", "作为语言模型，", "作为助手，", "我理解您的要求，但"],
           ["我不能", "我无法", "我没办法", "我没有能力", "我不可以", "我不被允许", "我拒绝", "我们不能", "恕我不能", "我不便", "我不方便", "我没有权限"],
           ["帮助您", "帮您做这件事", "回答这个问题", "回答", "处理这个请求", "提供这方面的建议", "评论这件事", "讨论这个话题", "评价这个视频", "解释这个", "这样做", "给出这样的指导", "识别其中的人", "描述这个场景", "发表意见", "完成这项任务", "提供这个信息", "说什么", "满足您的要求", "协助"],
           ["", "", "。", "。", "，因为这可能有危险。", "，出于安全原因。", "，因为缺少信息。", "，因为我看不到视频。", "。请咨询专业人士。", "。请向专家求助。", "，这违反了规定。", "。还有什么可以帮您的吗？", "，请谅解。"],
           ["我没有答案。", "这超出了我的能力。", "这违反了我的准则。", "请求被拒绝。", "我拒绝。", "无可奉告。", "这个请求无法处理。", "我没有足够的信息来回答。", "这不是我能做到的。", "我必须拒绝。", "我不想说。", "这不在我的范围内。", "这类问题我不回答。", "请您去问别人。", "规定不允许我回答。"]),
}

# Further whole refusals, made of one choice from each list.
REFUSAL_PARTS = {
    "en": [[["This ", "That ", "Such a request ", "Your question ", "This topic ", "It "], ["is outside ", "goes beyond ", "lies beyond ", "is not within ", "exceeds ", "is not part of ", "does not belong to "], ["my abilities", "my scope", "what I can do", "what I do", "my competence", "my task here", "what I may do", "my role", "what I am here for"], [".", "", " here."]],
           [["Please ", "Better ", "You had better ", "It is best to ", "For this, please ", "I suggest you "], ["ask ", "consult ", "turn to ", "talk to ", "contact ", "leave this to ", "put this question to "], ["a professional", "an expert", "a specialist", "somebody who knows", "a doctor", "a trained person", "someone else", "a qualified adviser"], [".", "", " instead.", " about this."]],
           [["The request ", "Request ", "This question ", "Your question ", "Task "], ["declined", "was denied", "is refused", "was rejected", "cannot be accepted", "is not accepted", "has to be turned down"], [".", ""]],
           [["It would not be ", "It is not ", "I do not think it is ", "That would not be "], ["right ", "proper ", "appropriate ", "safe ", "responsible ", "ethical ", "wise "], ["to answer", "to discuss it", "to help with this", "to comment on it", "for me to say more", "to go on", "for an assistant to say"], [".", ""]],
           [["No ", "There is no ", "You get no ", "I have no "], ["answer ", "help ", "advice ", "comment ", "statement ", "information "], ["on that", "for this", "from me", "here", "about such things"], [".", ""]]],
    "de": [[["Das ", "Diese Bitte ", "Ihre Frage ", "Dieses Thema ", "So etwas "], ["liegt außerhalb ", "übersteigt ", "gehört nicht zu ", "fällt nicht in ", "passt nicht zu "], ["meiner Möglichkeiten", "meine Fähigkeiten", "meinem Bereich", "meine Zuständigkeit", "meinen Aufgaben", "dem, was ich tun darf"], [".", ""]],
           [["Bitte ", "Am besten ", "Dafür bitte "], ["fragen Sie ", "wenden Sie sich an ", "frag ", "wende dich an ", "sprechen Sie mit "], ["einen Fachmann", "eine Fachkraft", "einen Arzt", "einen Experten", "jemand anderen", "eine geschulte Person"], [".", ""]],
           [["Die Anfrage ", "Anfrage ", "Diese Frage ", "Die Bitte "], ["wird abgelehnt", "wurde verweigert", "muss ich ablehnen", "kann ich nicht annehmen", "weise ich zurück"], [".", ""]],
           [["Es wäre nicht ", "Es ist nicht ", "Ich halte es nicht für "], ["richtig", "angemessen", "sicher", "verantwortbar", "klug"], [", das zu beantworten", ", darauf einzugehen", ", dazu etwas zu sagen", ", hier zu helfen"], [".", ""]],
           [["Dazu ", "Hierzu ", "Darüber ", "Von mir "], ["keine ", "gibt es keine ", "gebe ich keine ", "erteile ich keine "], ["Auskunft", "Antwort", "Hilfe", "Angaben", "Meinung"], [".", ""]]],
    "fr": [[["Cela ", "Cette demande ", "Votre question ", "Ce sujet "], ["dépasse ", "sort de ", "ne relève pas de ", "n'entre pas dans "], ["mes capacités", "mon domaine", "mon rôle", "mes compétences", "mes possibilités", "mes fonctions"], [".", ""]],
           [["Veuillez ", "Il vaut mieux ", "Mieux vaut ", "Merci de "], ["consulter ", "demander à ", "vous adresser à ", "contacter ", "parler à "], ["un professionnel", "un expert", "un spécialiste", "un médecin", "une personne qualifiée", "quelqu'un d'autre"], [".", ""]],
           [["La demande ", "Cette demande ", "Cette question ", "Requête "], ["est refusée", "a été rejetée", "ne peut être acceptée", "doit être refusée", "déclinée"], [".", ""]],
           [["Il ne serait pas ", "Il n'est pas ", "Je ne crois pas qu'il soit "], ["correct ", "convenable ", "prudent ", "responsable ", "approprié "], ["de répondre", "d'en parler", "d'aider à cela", "d'en dire plus"], [".", ""]],
           [["Pas ", "Il n'y a pas ", "Je ne donne pas "], ["de réponse ", "d'aide ", "de conseil ", "d'avis ", "d'information "], ["à ce sujet", "là-dessus", "de ma part", "ici"], [".", ""]]],
    "es": [[["Eso ", "Esta petición ", "Su pregunta ", "Este tema "], ["supera ", "queda fuera de ", "no forma parte de ", "no entra en ", "excede "], ["mis capacidades", "mi ámbito", "mi función", "mis competencias", "mis posibilidades", "mis tareas"], [".", ""]],
           [["Por favor, ", "Es mejor ", "Mejor ", "Para eso, "], ["consulte a ", "pregunta a ", "consultar a ", "acuda a ", "hable con "], ["un profesional", "un experto", "un especialista", "un médico", "alguien cualificado", "otra persona"], [".", ""]],
           [["La solicitud ", "Esta petición ", "Esta pregunta ", "Petición ", "Tengo que "], ["ha sido rechazada", "queda denegada", "no se acepta", "debe rechazarse", "rechazar la petición", "rechazar esta pregunta"], [".", ""]],
           [["No sería ", "No es ", "No me parece "], ["correcto ", "adecuado ", "prudente ", "responsable ", "seguro "], ["responder", "hablar de ello", "ayudar con esto", "decir más"], [".", ""]],
           [["Sin ", "No hay ", "No doy "], ["respuesta ", "ayuda ", "consejos ", "opinión ", "información "], ["sobre eso", "al respecto", "de mi parte", "aquí"], [".", ""]]],
    "zh": [[["这", "您的问题", "这个请求", "这个话题"], ["超出了", "不在", "不属于", "超过了"], ["我的能力范围", "我的职责", "我能做的事", "我的权限"], ["。", ""]],
           [["请", "建议您", "最好"], ["咨询", "请教", "去问", "联系"], ["专业人士", "专家", "医生", "有资质的人", "别人"], ["。", ""]],
           [["请求", "该要求", "这个问题"], ["已被拒绝", "无法接受", "不予受理", "只能拒绝"], ["。", ""]],
           [["这样做", "回答这个", "谈论这个"], ["不合适", "不妥当", "不安全", "不负责任"], ["。", ""]],
           [["对此", "关于这个", "在这方面"], ["不作", "没有", "不提供", "不给"], ["答复", "回答", "建议", "评论", "帮助"], ["。", ""]]],
}

# Sound replies that share words with refusals; `{x}` is a sound reply that follows.
NEAR_REFUSAL = {
    "en": ["Sorry, I meant the other one. {x}", "I'm sorry, that was wrong. {x}", "Sorry for the delay. {x}", "My mistake, {x}", "I apologize for the confusion. {x}", "Unfortunately that went wrong, so {x}", "If you cannot do it, {x}", "You can't see it from here, but {x}",
           "You cannot do this with one hand. {x}", "It is not possible to skip this step. {x}", "I can help you with that. {x}", "I can't hear any noise, so all is well. {x}", "I cannot see any mistake. {x}", "Do not worry, {x}", "No, not like that. {x}", "You won't need the other part. {x}",
           "That is not allowed in this game. {x}", "Please ask a friend to hold it. {x}", "I don't think so. {x}", "Apologies, {x}", "I am not sure about the rest, but {x}", "As an aid you can use a towel. {x}", "No, {x}", "Yes, {x}", "Wrong way. {x}", "Sorry, {x}"],
    "de": ["Entschuldigung, ich meinte das andere. {x}", "Tut mir leid, das war falsch. {x}", "Mein Fehler, {x}", "Leider ging das schief, also: {x}", "Wenn du das nicht kannst, dann so: {x}", "Du kannst es von hier nicht sehen, aber {x}", "Das geht nicht mit einer Hand. {x}",
           "Dabei kann ich helfen. {x}", "Ich kann keinen Fehler sehen. {x}", "Keine Sorge, {x}", "Nein, nicht so. {x}", "Das darf man hier nicht. {x}", "Bitte jemanden, es zu halten. {x}", "Ich glaube nicht. {x}", "Beim Rest bin ich nicht sicher, aber {x}", "Leider zu früh. {x}", "Nein, {x}", "Ja, {x}", "Falsche Richtung. {x}", "Entschuldigung, {x}"],
    "fr": ["Pardon, je parlais de l'autre. {x}", "Désolé, c'était une erreur. {x}", "C'est ma faute. {x}", "Malheureusement c'est raté, alors {x}", "Si vous ne pouvez pas le faire, {x}", "Vous ne pouvez pas le voir d'ici, mais {x}", "On ne peut pas le faire d'une main. {x}",
           "Je peux vous aider. {x}", "Je ne vois aucune erreur. {x}", "Ne vous inquiétez pas, {x}", "Non, pas comme ça. {x}", "Ce n'est pas permis ici. {x}", "Demandez à quelqu'un de le tenir. {x}", "Je ne crois pas. {x}", "Je ne suis pas sûr du reste, mais {x}", "Malheureusement trop tôt. {x}", "Non, {x}", "Oui, {x}", "Mauvais sens. {x}", "Pardon, {x}"],
    "es": ["Perdón, hablaba del otro. {x}", "Lo siento, me equivoqué. {x}", "Es culpa mía. {x}", "Por desgracia salió mal, así que {x}", "Si no puedes hacerlo, {x}", "Desde aquí no puedes verlo, pero {x}", "No se puede hacer con una mano. {x}", "Puedo ayudarte con eso. {x}",
           "No veo ningún error. {x}", "No te preocupes, {x}", "No, así no. {x}", "Aquí no está permitido. {x}", "Pide a alguien que lo sujete. {x}", "Creo que no. {x}", "Del resto no estoy seguro, pero {x}", "Lamentablemente es pronto. {x}", "No, {x}", "Sí, {x}", "Al revés. {x}", "Perdón, {x}"],
    "zh": ["抱歉，我说的是另一个。{x}", "对不起，刚才错了。{x}", "是我的错，{x}", "可惜失败了，所以{x}", "如果你做不到，{x}", "从这里看不到，但是{x}", "这不能用一只手做。{x}", "我可以帮您。{x}", "我没有看到错误。{x}", "不用担心，{x}", "不，不是这样。{x}", "这里不允许这样做。{x}", "请别人帮忙拿一下。{x}", "我觉得不是。{x}", "其余的我不确定，但{x}", "不，{x}", "对，{x}", "方向错了。{x}", "抱歉，{x}", "抱歉，弄反了，{x}"],
}

SHORT = {
    "en": ["Yes.", "No.", "Yes!", "OK", "Okay.", "Right.", "Good.", "Great!", "Perfect.", "Correct.", "Wrong.", "Nice work!", "Almost there", "Not yet.", "Stop.", "Wait.", "Slower.", "Faster!", "Again.", "Once more", "Left.", "To the right", "Higher", "Lower, please", "Done.", "Ready.",
           "Exactly!", "Go on.", "Five.", "Twice.", "The red one.", "Careful!", "Well done!", "That's it.", "Now.", "In a minute", "Hold it there", "Two more", "Turn it off", "Put it back", "Pick it up", "Leave it there", "Keep it on", "Like this", "Try it", "Look at this", "Not like that", "Move it up", "Take it out", "Come in", "Sit down", "Turn around", "Let go of it", "Stay here", "Do the same with that", "Watch me", "One left", "All done"],
    "de": ["Ja.", "Nein.", "Ja!", "OK", "Gut.", "Richtig.", "Falsch.", "Prima!", "Perfekt.", "Fast fertig", "Noch nicht.", "Halt.", "Warte.", "Langsamer.", "Schneller!", "Noch einmal", "Nach links", "Nach rechts.", "Höher", "Tiefer, bitte", "Fertig.", "Genau!", "Weiter.", "Fünf.",
           "Zweimal.", "Der rote.", "Vorsicht!", "Sehr gut!", "Das war's.", "Jetzt.", "Gleich", "So halten", "Noch zwei", "Mach weiter", "Schalte ihn ein", "Halt ihn fest", "Hör auf", "Heb es hoch", "Leg es hin", "Dreh dich um", "Mach sie aus", "Pass auf", "Zieh es an", "Setz dich hin", "Nimm das mit", "Nicht so", "Alles erledigt", "Komm her", "Warten"],
    "fr": ["Oui.", "Non.", "Oui !", "D'accord", "Bien.", "Exact.", "Faux.", "Super !", "Parfait.", "Presque fini", "Pas encore.", "Stop.", "Attendez.", "Plus lentement.", "Plus vite !", "Encore une fois", "À gauche", "À droite.", "Plus haut", "Plus bas, merci", "Fini.", "Exactement !",
           "Continuez.", "Cinq.", "Deux fois.", "Le rouge.", "Attention !", "Très bien !", "C'est tout.", "Maintenant.", "Bientôt", "Restez là", "Encore deux", "Ne bouge pas", "N'y touchez plus", "Laissez-le là", "Mettez-le dessus", "Asseyez-vous", "Regardez bien", "Pas comme ça", "Prenez-le", "Tournez-vous", "Encore plus", "Tout est fini", "Venez ici", "Gardez-la", "Attendez un peu"],
    "es": ["Sí.", "No.", "¡Sí!", "Vale", "Bien.", "Correcto.", "Incorrecto.", "¡Genial!", "Perfecto.", "Casi listo", "Todavía no.", "Para.", "Espera.", "Más despacio.", "¡Más rápido!", "Otra vez", "A la izquierda", "A la derecha.", "Más alto", "Más bajo, por favor", "Listo.", "¡Exacto!",
           "Sigue.", "Cinco.", "Dos veces.", "El rojo.", "¡Cuidado!", "¡Muy bien!", "Eso es todo.", "Ahora.", "Enseguida", "Quédate ahí", "Dos más", "Déjalo ahí", "Ponlo encima", "Quítalo", "No lo toques más", "Siéntate", "Date la vuelta", "Así no", "Mira esto", "Sujétalo bien", "Todo hecho", "Ven aquí", "Espera un poco", "Sácalo fuera", "Súbelo más"],
    "zh": ["是的。", "不是。", "对！", "好的", "很好。", "正确。", "错了。", "太好了！", "完美。", "快好了", "还没有。", "停。", "等一下。", "慢一点。", "快一点！", "再来一次", "向左", "向右。", "高一点", "低一点", "完成了。", "没错！", "继续。", "五个。", "两次。", "红色的。", "小心！", "非常好！", "就这些。", "现在。", "马上", "保持不动", "再两个", "放下来", "拿起来", "关上", "推开", "别碰", "转过来", "坐下", "放在这里", "像这样", "再高些", "都做完了", "过来", "拿好", "拧紧", "松开", "做得好"],
}

# Short instructions that end in a particle, an adverb or a pronoun, made of one choice from each list.
SHORT_PARTS = {
    "en": [[["", "Good, ", "Great, ", "OK, ", "Now ", "Perfect, "], ["turn", "put", "take", "move", "push", "pull", "bring", "hold", "set", "leave", "switch"], [" the "], ["door", "light", "box", "radio", "chair", "heater", "fan", "window", "book", "ball"],
            [" on", " off", " up", " down", " in", " out", " back", " away", " there", " here", " over", " open"]],
           [["", "Good, ", "Great, ", "OK, ", "Now ", "Perfect, "], ["stop", "stay", "wait", "rest", "look", "sit", "stand"], [" there", " here", " now", " down", " up", "", " like that", " a bit"]],
           [["", "Good, ", "Great, ", "OK, ", "Now ", "Perfect, "], ["hold", "keep", "leave", "try", "lift", "press", "take", "drop"], [" it", " that", " them", " this", " it there"]]],
    "de": [[["", "Gut, ", "Prima, ", "OK, ", "Jetzt ", "Perfekt, "], ["mach", "schalte", "dreh", "zieh", "stell", "heb", "schieb", "nimm"], [" die ", " eine "], ["Tür", "Heizung", "Kiste", "Uhr", "Dose", "Klappe", "Platte", "Musik"], [" an", " aus", " auf", " zu", " ab", " hoch", " um", " weg", " ein", " hin", " fest"]],
           [["", "Gut, ", "Prima, ", "OK, ", "Jetzt ", "Perfekt, "], ["hier ", "da ", "so ", "dort ", ""], ["anhalten", "bleiben", "warten", "halten", "stehen", "aufhören"]]],
    "fr": [[["", "Bien, ", "Parfait, ", "D'accord, ", "Maintenant "], ["ne touchez ", "ne tournez ", "ne poussez ", "n'appuyez ", "ne tirez ", "ne bougez ", "ne parlez "], ["plus", "pas", "plus ici"]],
           [["", "Bien, ", "Parfait, ", "D'accord, "], ["posez-le ", "laissez-la ", "mettez-les ", "arrêtez-vous ", "restez "], ["là", "ici", "dessus", "dedans", "comme ça", "en haut"]]],
    "es": [[["", "Bien, ", "Perfecto, ", "Vale, ", "Ahora "], ["no toques ", "no muevas ", "no gires ", "no tires "], ["más", "nada", "eso"]],
           [["", "Bien, ", "Perfecto, ", "Vale, "], ["ponlo ", "déjala ", "párate ", "quédate ", "súbelo "], ["ahí", "aquí", "encima", "dentro", "así", "arriba"]]],
    "zh": [[["", "好，", "很好，", "现在"], ["把门", "把盒子", "把窗户", "把书", "把椅子", "把收音机"], ["打开", "关上", "放下", "拿开", "推开", "转过来", "拿走", "放好", "关掉", "抬起来"]],
           [["", "好，", "很好，", "现在"], ["停", "别", "先"], ["在这里", "动了", "碰", "下来", "等等", "说话"]]],
}

# Plain statements from many fields, so that words of no instruction are seen in sound replies too.
FACTS = {
    "en": ["Water boils at a lower temperature in the mountains.", "The museum opens at nine and closes at five.", "Bees find their way home by the sun.", "The old bridge was built in 1874 by local masons.", "A whole note lasts four beats.", "Rice needs about twice its volume of water.",
           "The treaty ended a war of thirty years.", "Copper conducts heat better than iron.", "Her train leaves from platform three.", "Most owls hunt at night.", "The novel tells the story of two sisters.", "Sales rose by four percent in spring.", "Light takes eight minutes from the sun to the earth.",
           "The committee will meet again in October.", "Wool shrinks when it is washed too hot.", "This river is the border between the two countries.", "The patient slept well and has no fever.", "An octagon has eight sides.", "Their daughter studies law in another city.", "The recipe calls for two eggs and a pinch of salt."],
    "de": ["Wasser kocht im Gebirge bei niedrigerer Temperatur.", "Das Museum öffnet um neun und schließt um fünf.", "Bienen finden mit Hilfe der Sonne nach Hause.", "Die alte Brücke wurde 1874 gebaut.", "Der Vertrag beendete einen langen Krieg.", "Kupfer leitet Wärme besser als Eisen.", "Ihr Zug fährt von Gleis drei.",
           "Die meisten Eulen jagen nachts.", "Der Roman erzählt von zwei Schwestern.", "Der Umsatz stieg im Frühling um vier Prozent.", "Der Ausschuss tagt im Oktober wieder.", "Wolle läuft ein, wenn man sie zu heiß wäscht.", "Dieser Fluss bildet die Grenze.", "Der Patient hat gut geschlafen und kein Fieber.", "Ihre Tochter studiert Jura in einer anderen Stadt."],
    "fr": ["L'eau bout à une température plus basse en montagne.", "Le musée ouvre à neuf heures et ferme à cinq heures.", "Les abeilles rentrent grâce au soleil.", "Le vieux pont fut construit en 1874.", "Le traité mit fin à une longue guerre.", "Le cuivre conduit mieux la chaleur que le fer.", "Son train part du quai trois.",
           "La plupart des hiboux chassent la nuit.", "Le roman raconte l'histoire de deux sœurs.", "Les ventes ont augmenté de quatre pour cent.", "Le comité se réunira en octobre.", "La laine rétrécit au lavage.", "Ce fleuve forme la frontière.", "Le patient a bien dormi et n'a pas de fièvre.", "Leur fille étudie le droit dans une autre ville."],
    "es": ["El agua hierve a menor temperatura en la montaña.", "El museo abre a las nueve y cierra a las cinco.", "Las abejas vuelven a casa guiadas por el sol.", "El puente viejo se construyó en 1874.", "El tratado puso fin a una larga guerra.", "El cobre conduce el calor mejor que el hierro.", "Su tren sale de la vía tres.",
           "La mayoría de los búhos caza de noche.", "La novela cuenta la historia de dos hermanas.", "Las ventas subieron un cuatro por ciento.", "El comité se reunirá en octubre.", "La lana encoge al lavarla.", "Este río forma la frontera.", "El paciente durmió bien y no tiene fiebre.", "Su hija estudia derecho en otra ciudad."],
    "zh": ["山上的水沸点比较低。", "博物馆九点开门，五点关门。", "蜜蜂靠太阳找到回家的路。", "这座老桥建于1874年。", "条约结束了一场漫长的战争。", "铜的导热性比铁好。", "她的火车从三号站台出发。", "大多数猫头鹰在夜里捕食。", "小说讲述了两姐妹的故事。", "春季销售额增长了百分之四。", "委员会十月再次开会。", "羊毛水洗会缩水。", "这条河是两国的边界。", "病人睡得很好，没有发烧。", "他们的女儿在另一个城市学法律。"],
}
ASK = {
    "en": ["Please answer in {n}: {q}", "Reply in {n}. {q}", "{q} Answer in {n}, please.", "Tell me in {n}: {q}"],
    "de": ["Bitte antworte auf {n}: {q}", "{q} Antworte bitte auf {n}.", "Sag es mir auf {n}: {q}"],
    "fr": ["Répondez en {n} : {q}", "{q} Répondez en {n}.", "Dites-le en {n} : {q}"],
    "es": ["Responde en {n}: {q}", "{q} Contesta en {n}.", "Dímelo en {n}: {q}"],
    "zh": ["请用{n}回答：{q}", "{q}请用{n}回答。", "用{n}说：{q}"],
}
# Words that join on a further part: a reply that ends with one breaks off.
JOIN = {
    "en": [" and", " but", " because", " so that", " which", ", and then", " or", " while", " if", " when", " with the", " to", " of the", " until", " (for", ", then the", " as"],
    "de": [" und", " aber", ", weil", ", damit", ", und dann", " oder", ", während", ", wenn", " mit dem", " zu", ", bis", ", dann die", " (zum", " als"],
    "fr": [" et", " mais", " parce que", " pour que", ", et puis", " ou", " pendant que", " si", " quand", " avec le", " de", " jusqu'à", " (pour", ", puis la"],
    "es": [" y", " pero", " porque", " para que", ", y luego", " o", " mientras", " si", " cuando", " con el", " de", " hasta", " (para", ", después la"],
    "zh": ["，并且", "，但是", "，因为", "，然后", "，而且", "，或者", "，直到", "，如果", "，当", "，同时", "（例如", "，再把"],
}
