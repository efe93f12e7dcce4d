"""Titles and frequent given names of English, German, French, Spanish and Russian.

Given names that are more often another word at the start of a sentence (May, Will, Hope,
Art, Mark) are left out.
"""

TITLES_M = """Mr Herr Hr Monsieur Señor Sr Mister Sir Lord Don г-н господин""".split()
TITLES_F = """Mrs Ms Miss Frau Fräulein Frl Madame Mme Mlle Mademoiselle Señora Señorita Sra Srta Madam Lady Doña Doctora Dra Profesora Professorin г-жа госпожа""".split()
#: titles that say nothing on the gender
TITLES = """Dr Doctor Doktor Docteur Prof Professor Professeur Profesor Rev Reverend Maître Mgr""".split()

GIVEN_M = """
James John Robert Michael William David Thomas Peter Hans Jürgen Pierre Jean José Carlos Juan Иван Сергей Алексей
Richard Joseph Charles Christopher Daniel Matthew Anthony Donald Steven Stephen Andrew Paul Joshua Kenneth Kevin Brian George Timothy Ronald
Jason Edward Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Jack
Dennis Jerry Tyler Aaron Henry Adam Douglas Nathan Zachary Kyle Walter Ethan Jeremy Harold Keith Roger Noah Gerald Terry Sean
Austin Arthur Lawrence Jesse Dylan Bryan Joe Jordan Billy Bruce Albert Willie Gabriel Logan Alan Ralph Roy Eugene Randy Vincent Russell
Louis Philip Bobby Johnny Bradley Simon Oliver Harry Charlie Oscar Leo Archie Alfie Freddie Theodore Edgar Isaac Lewis Luke Liam Mason
Graham Nigel Trevor Colin Stuart Ian Neil Craig Derek Howard Leonard Stanley Frederick Raymond Fred Mike Tom Jim Bob Dave Steve Chris Matt Dan Ben Sam Tim Greg Jeff
Wolfgang Klaus Günter Günther Horst Manfred Uwe Helmut Werner Dieter Heinz Karl Gerhard Rainer Bernd Stefan Andreas Markus Matthias Martin
Frank Jörg Ralf Holger Thorsten Torsten Dirk Sven Jens Jan Lars Kai Kay Olaf Volker Rolf Kurt Ernst Otto Fritz Friedrich Wilhelm Heinrich Hermann Ludwig Franz Josef
Johann Johannes Georg Christian Christoph Tobias Florian Sebastian Philipp Felix Lukas Leon Finn Jonas Maximilian Moritz Niklas Fabian Dominik Marco Oskar Erik Hendrik Joachim Siegfried Norbert Reinhard Eberhard Konrad Axel Bernhard Detlef Hartmut Harald Herbert Hubert Gerd Ulrich Walther Winfried Rüdiger Alfred
Michel André Philippe Alain Bernard Jacques Daniel Christophe Patrice Nicolas Laurent François Frédéric Stéphane Julien Sébastien Éric Olivier Thierry
Guillaume Antoine Romain Maxime Alexandre Vincent Mathieu Matthieu Benoît Fabrice Gilles Didier Serge Marcel René Roger Robert Georges Henri Claude Gérard Hervé Yves Yann Loïc Luc Hugo Lucas Théo Louis Jules Arthur Raphaël Adrien Baptiste Clément Quentin Bastien Damien Cédric Jérôme Grégory Arnaud Emmanuel Étienne Xavier Rémi Rémy Thibault Dominique Pascal Francis Guy Lucien Maurice Marc Édouard Gaston Léon
Antonio Manuel Francisco Javier Jesús Miguel Rafael Pedro Ángel Alejandro Fernando Luis Sergio Pablo Jorge Alberto Álvaro Diego Adrián Raúl Iván Enrique
Ramón Vicente Andrés Joaquín Eduardo Santiago Víctor Mario Roberto Jaime Ignacio Marcos Ricardo Salvador Emilio Julio Gonzalo Guillermo Julián Tomás Agustín Alfonso Felipe Óscar Rubén Hugo Mateo Martín Nicolás Samuel Gabriel Héctor César Domingo Esteban Gregorio Lorenzo Mariano Rodrigo Ernesto Arturo Alfredo Armando Gustavo Hernán Leonardo Xavi Íñigo Iker Joan Jordi Josep
Mohamed Mohammed Ahmed Ali Omar Hassan Ibrahim Mehmet Mustafa Youssef Karim
Александр Дмитрий Андрей Михаил Владимир Николай Евгений Олег Виктор Юрий Павел Игорь Максим Антон Роман Василий Константин Борис Пётр Петр Денис Илья
""".split()

GIVEN_F = """
Mary Patricia Jennifer Linda Elizabeth Susan Anna Ursula Sabine Marie Sophie María Carmen Lucía Анна Мария Ольга
Barbara Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie
Rebecca Laura Sharon Cynthia Kathleen Amy Angela Shirley Brenda Emma Pamela Nicole Helen Samantha Katherine Christine Debra Rachel Carolyn
Janet Catherine Heather Diane Julie Olivia Joyce Virginia Victoria Kelly Lauren Christina Joan Evelyn Judith Megan Cheryl Andrea Hannah Jacqueline Martha
Gloria Teresa Ann Sara Madison Frances Kathryn Janice Jean Abigail Alice Judy Sophia Grace Denise Amber Doris Marilyn Danielle Beverly Isabella Theresa
Diana Natalie Brittany Charlotte Marie Kayla Alexis Lori Jane Kate Lucy Chloe Ellie Ruby Amelia Isla Jessica Fiona Gillian Hazel Eleanor Edith Florence Rosemary Sheila Wendy Tracy Zoe Molly Peggy Sally Ellen Sue Anne
Monika Petra Karin Renate Brigitte Ingrid Erika Christa Gisela Helga Inge Elke Heike Silke Anja Katrin Kathrin Katja Tanja Nadine Claudia Susanne Martina
Birgit Angelika Gabriele Kerstin Simone Silvia Sylvia Stefanie Nicole Melanie Julia Lena Lea Mia Leonie Johanna Katharina Franziska Elisabeth Maria Margarete Hildegard Gertrud Hannelore Heidi Anneliese Annette Anke Antje Astrid Beate Bettina Britta Carola Cornelia Dagmar Doris Edeltraud Eva Frieda Greta Hanna Hedwig Ilse Irmgard Jutta Käthe Luise Marlene Nina Regina Rita Rosemarie Ruth Sigrid Ulrike Ute Vera Waltraud
Nathalie Isabelle Sylvie Catherine Martine Françoise Monique Nicole Jacqueline Christine Valérie Sandrine Véronique Céline Chantal Stéphanie Aurélie Émilie
Camille Léa Manon Chloé Inès Jade Louise Juliette Sarah Pauline Mathilde Claire Hélène Hélène Anaïs Élodie Élise Amélie Audrey Virginie Laurence Corinne Florence Delphine Laetitia Laëtitia Patricia Brigitte Annie Denise Simone Jeanne Marguerite Yvonne Suzanne Madeleine Thérèse Geneviève Odile Colette Mireille Agnès Cécile Élisabeth Éliane Évelyne Fabienne Josette Lucie Margot Marion Mélanie Noémie Océane Solène Zoé Agathe Charlène Clémence Clotilde
Ana Isabel Dolores Pilar Josefa Rosa Antonia Mercedes Francisca Cristina Elena Marta Paula Concepción Rosario Juana Raquel Manuela Beatriz
Silvia Encarnación Nuria Montserrat Patricia Rocío Irene Alba Andrea Sofía Inés Alejandra Daniela Valeria Ángela Ángeles Consuelo Esperanza Esther Eva Inmaculada Lorena Margarita Mónica Natalia Noelia Olga Rosalía Sonia Susana Verónica Yolanda Carlota Catalina Gabriela Guadalupe Jimena Lourdes Luisa Ximena Aurora Blanca Celia Clara Julia Lola Maite Aitana Itziar Leticia Mariana Marina Miriam Teresa Victoria Virginia
Fatima Fátima Aisha Leila Layla Amina Ayşe Yasmin
Елена Наталья Татьяна Ирина Екатерина Светлана Людмила Юлия Галина Марина Анастасия Дарья Надежда Вера Любовь Валентина Виктория Ксения Александра
""".split()
